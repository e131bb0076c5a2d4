"""Text operators against brute force on edge cases, empty tables and clashing names."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from conftest import shuffled
from pyspark.sql import functions as F

import public_tokenizers
from zonometry.llm import bpe, classifier, decontaminate, lines, neardup, quality, suffixes
from zonometry.llm import common as C

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_rows(df, *cols):
    return Counter(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*cols).collect())


def test_operators_on_empty_tables(nothing, spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert lines.dedup_lines(nothing).count() == 0
    assert suffixes.remove_repeats(nothing).count() == 0
    assert decontaminate.contaminated(nothing, items).count() == 0
    assert quality.quality_rules(nothing).count() == 0
    assert neardup.near_duplicates(nothing).count() == 0
    assert bpe.decode(bpe.encode(nothing)).count() == 0
    assert classifier.score(nothing, classifier.fit(nothing, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


def test_empty_benchmark_hits_nothing(edges, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.contaminated(edges, none)
    assert out.count() == edges.count() and out.where("n_hit > 0").count() == 0


@pytest.mark.parametrize("name, apply", [
    ("n_lines", lines.dedup_lines), ("removed", suffixes.remove_repeats), ("kept", quality.quality_rules), ("component_id", neardup.near_duplicates),
    ("ids", bpe.encode), ("score", lambda d: classifier.score(d, (np.zeros(classifier.BUCKETS, np.float32), 0.0))), ("N_HIT", lambda d: decontaminate.contaminated(d, d, item_id="doc_id")),
])
def test_added_names_are_refused(edges, name, apply):
    with pytest.raises(ValueError, match=name.lower()):
        apply(edges.withColumn(name, F.lit(1)))


# --- line dedup


def apart(a, b):
    """Word edits, up to one: 0, 1 or 2 for more."""
    if a == b:
        return 0
    if len(a) == len(b):
        return min(2, sum(x != y for x, y in zip(a, b)))
    if len(a) < len(b):
        a, b = b, a
    return 1 if len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a))) else 2


def test_line_dedup_matches_all_pairs(spark):
    base = "a b c d e f g h i j k l".split()
    texts = {
        1: [" ".join(base), "short line", "x y z"],
        2: [" ".join(base[:5] + base[6:]), "short line", "x y z", ""],  # one word fewer than an earlier line
        3: [" ".join(base[:3] + ["new"] + base[3:]), " ".join(base[:4] + ["other"] + base[5:])],  # one more; one replaced
        4: [" ".join(base[:4] + ["other"] + base[5:8] + ["two"] + base[9:])],  # within one of the line before it only
        5: [" ".join(["first", *base[1:]]), " ".join([*base[:-1], "last"]), "x  y z"],
        6: ["q w e r t y u i o p", "q w e r t y u i o p p", "p q w e r t y u i o p"],
        7: ["a a a a a a a a a a", "a a a a a a a a a a a", "a a a a b a a a a a"],
    }
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in texts.items()] + [(None, " ".join(base)), (8, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.dedup_lines(shuffled(docs)).collect()}
    order = [(i, k, [w for w in line.split(" ") if w]) for i, own in texts.items() for k, line in enumerate(own)] + [(None, 0, base)]
    for at, (i, k, w) in enumerate(order):
        gone = len(w) >= 3 and any(w == v or (len(w) >= 10 and len(v) >= 10 and apart(w, v) == 1) for _, _, v in order[:at])
        if i is not None:
            texts[i][k] = None if gone else texts[i][k]
        else:
            assert got[None].n_dropped == int(gone)
    for i, own in texts.items():
        assert got[i].text == "\n".join(x for x in own if x is not None), i
        assert got[i].n_dropped == sum(x is None for x in own)
    assert got[8].text is None and got[8].n_lines == 0


def test_every_line_is_compared_when_asked_for(spark):
    row, han = "\t".join(f"cell{k}" for k in range(12)), "".join(chr(0x4E00 + 7 * k) for k in range(60))
    plain = "abcdefghijklmnopqrstuvwxyz" * 2
    texts = [
        ["yes", "two words", row, "a\u00a0b\u00a0c", han, "seven words and no more than these stay", "nine words of which one is spelled another way", " ".join(plain)],
        ["yes", "no", "two  words", "two other", row, row.replace("cell5", "cell"), "a b c", han, " ", ""],
        [han[:20] + "x" + han[21:], han[:30] + han[31:], han[:10] + "yz" + han[12:], plain, "seven words and no more than these stays", "nine words of which one is spelt another way", "nine words of which one is speled another way"],
        ["yes", "no", " "],
    ]
    want = [texts[0], ["no", "two other", " ", ""], [han[:10] + "yz" + han[12:], plain, "seven words and no more than these stays", "nine words of which one is spelt another way"], [" "]]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(shuffled(docs), every=True).collect()}
    assert [got[i].split("\n") for i in range(4)] == want


def test_line_dedup_on_edge_rows(edges):
    out = lines.dedup_lines(edges)
    assert out.columns == [*edges.columns, "n_lines", "n_dropped"] and out.count() == edges.count()
    by = {r.doc_id: r for r in out.collect() if r.doc_id not in (2, 4, 9, None)}
    assert by[1].n_dropped == 0 and by[3].text == "" and by[6].text == "" and by[5].text is None and by[7].text == " \n\t "
    assert as_rows(out.where("doc_id = 2"), "n_dropped") == {(0,): 2}  # a repeated row is the same document


def test_running_xor(spark):
    for n in (1, 2, 5, 26, 101):
        values = [int(x) for x in np.random.default_rng(n).integers(0, 2**60, n)]
        got = spark.createDataFrame([(values,)], "a array<long>").select(lines._running_xor(F.col("a"))).first()[0]
        assert got == np.bitwise_xor.accumulate(np.array(values)).tolist()


# --- repeated bytes


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 7, 50, 301):
        for letters in (1, 2, 5):
            s = rng.integers(0, letters, n)
            assert suffixes.suffix_array(s, 10**9).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_keys_beyond_21_bits_keep_the_order():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(0, 1 << 30, 500).astype(np.uint64) for _ in range(3))
    a[:250], b[:250] = a[250:], b[250:]
    assert np.argsort(suffixes._key(a, b, c), kind="stable").tolist() == np.lexsort((c, b, a)).tolist()


def removed_bytes(rows, width):
    """(id, text) rows -> {(id, text): flags of removed bytes}."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            rank = suffixes.NO_ID if i is None else i
            first[w] = min(first.get(w, rank), rank)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < (suffixes.NO_ID if i is None else i):
                gone[k : k + width] = b"\1" * width
        out[i, t] = gone
    return out


@pytest.mark.parametrize("hot", [None, 1])
def test_repeats_match_brute_force(edges, monkeypatch, hot):
    if hot is not None:  # every shared gram counts as common
        monkeypatch.setattr(suffixes, "HOT", hot)
    want = removed_bytes([(r.doc_id, r.text) for r in edges.collect()], suffixes.WIDTH)
    out = suffixes.remove_repeats(shuffled(edges))
    assert out.columns == [*edges.columns, "n_bytes", "removed", "kept"] and out.count() == edges.count()
    for r in out.collect():
        gone, b = want[r.doc_id, r.text], (r.text or "").encode()
        assert r.n_bytes == len(b)
        assert bytes(r.kept) == bytes(x for x, g in zip(b, gone) if not g), r.doc_id
        assert [(s.start, s.end) for s in r.removed] == [m.span() for m in re.finditer(b"\1+", bytes(gone))]


@pytest.mark.parametrize("hot", [None, 1])
def test_repeats_of_several_texts_under_one_id(spark, monkeypatch, hot):
    if hot is not None:
        monkeypatch.setattr(suffixes, "HOT", hot)
    parts = [" ".join(f"{p}{k}word" for k in range(30)) for p in "abcdefgh"]
    rows = [(1, parts[0] + parts[1]), (2, parts[2] + parts[0]), (2, parts[3] + "x" + parts[1]), (3, parts[3] + parts[2] + parts[4]),
            (None, parts[4] + parts[5]), (None, "y" + parts[6] + parts[0] + parts[5]), (None, parts[6] + parts[3]), (2, parts[2] + parts[0])]
    want = removed_bytes(rows, suffixes.WIDTH)
    out = suffixes.remove_repeats(shuffled(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert bytes(r.kept) == bytes(x for x, g in zip(r.text.encode(), want[r.doc_id, r.text]) if not g), (r.doc_id, r.text[:9])


# --- decontamination


def test_decontamination_matches_word_scan(edges, spark):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    rows = edges.collect()
    items = [(1, " ".join(re.findall(pattern, rows[0].text.translate(UPPER))[20:35])), (2, "ab"), (3, None), (4, ""), (5, "…!"), (6, rows[1].text.upper()), (6, "ab ab ab"), (7, "not there at all"), (None, "naïve")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(shuffled(edges), bench)
    assert got.columns[: len(edges.columns)] == edges.columns and got.count() == len(rows)
    wins = []
    for i, t in items:
        w = re.findall(pattern, (t or "").translate(UPPER))
        n = min(10, len(w))
        wins += [("" if i is None else str(i), w[k : k + n]) for k in range(len(w) - n + 1)] if n else []
    for r in got.collect():
        w = re.findall(pattern, (r.text or "").translate(UPPER))
        hit, who = [0] * len(w), set()
        if len(w) < 5000:
            for item, x in wins:
                for k in range(len(w) - len(x) + 1):
                    if w[k : k + len(x)] == x:
                        hit[k : k + len(x)] = [1] * len(x)
                        who.add(item)
            assert (r.n_words, r.n_hit, r["items"]) == (len(w), sum(hit), sorted(who)), r.doc_id
            assert sum(s.end - s.start for s in r.hit_spans) == sum(hit)


# --- BPE


def test_bpe_is_tiktoken_and_round_trips(edges):
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.RANKS), special_tokens={})
    out = bpe.decode(bpe.encode(shuffled(edges)))
    assert out.columns == [*edges.columns, "n_tokens", "ids", "decoded"] and out.count() == edges.count()
    for r in out.collect():
        ids = enc.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(r.decoded) == (r.text or "").encode()


# --- quality


def test_statistics_match_row_loop(edges):
    for r in quality.statistics(shuffled(edges)).collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = Counter(zip(w, w[1:], w[2:]))
        rep = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        own = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), len(rep))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id


def test_quality_rules_on_edge_rows(edges):
    out = quality.quality_rules(edges)
    assert out.count() == edges.count()
    assert out.where("n_words < 50 and kept").count() == 0 and out.where("doc_id = 12 and base_failed").count() == 1


def test_outliers_go_and_clean_rows_stay(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        n = int(rng.integers(80, 400))
        bad = i % 9 == 0
        rows.append((i, " ".join("".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 8)))) + ("$%&" if bad else "") for _ in range(n)), ["en", "de"][i % 2], "s" if i % 3 else "t"))
    out = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert out.where("kept = (doc_id % 9 = 0)").count() == 0


def test_determinant_fit_matches_numpy_steps(spark):
    """One group: the centre is that of an exact concentration on the same rows, to the width of a distance bin."""
    rng = np.random.default_rng(2)
    n = rng.integers(100, 500, 600)
    chars = (n * rng.normal(5, 0.15, 600)).astype(int)
    chars[:90] = n[:90] * 12
    data = [(int(a), int(b), 0, 0, 0, 10, int(a / 10)) for a, b in zip(n, chars)]
    stats = spark.createDataFrame(data, ", ".join(f"{c} long" for c in quality.STATS)).withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))
    keys, params = quality.fit(stats, ["lang", "source"])
    centre = params.join(keys, "fit").first()["centre"]
    clean = np.log(chars[90:] / n[90:])
    assert abs(centre[0] - clean.mean()) < 0.01
    assert abs(quality.chi2_cdf(quality.chi2_quantile(0.975, 5), 5) - 0.975) < 1e-9 and abs(quality.chi2_quantile(0.95, 2) - 5.991) < 1e-2


def test_repeated_lines_and_phrases_are_outliers(spark):
    """Texts that pass the base rules, but in which nearly every line repeats one, or just under half of the words stand in repeated phrases."""
    rng, rows, made = np.random.default_rng(6), [], iter(range(10**9))

    def new(n):
        return [f"w{next(made):05d}" for _ in range(n)]

    for i in range(600):
        n = int(rng.integers(8, 40))
        if i % 20 == 0:
            rows.append((i, "\n".join(rng.choice(new(20), 100 + n))))
        elif i % 20 == 1:
            phrase = new(6)
            rows.append((i, "\n".join(" ".join(phrase + new(7)) for _ in range(n + 2))))
        else:
            own = [" ".join(new(12)) for _ in range(n)]
            rows.append((i, "\n".join(own + own[:1])))  # one repeated line rejects nothing
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    out = quality.quality_rules(docs).collect()
    assert not any(r.base_failed for r in out)
    assert [r.doc_id for r in out if r.kept == (r.doc_id % 20 < 2)] == []


# --- near duplicates


def brute_components(rows, width):
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets[i] = frozenset(s)
        parent[i] = i

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_match_all_pairs(spark, width):
    from conftest import words

    rng, rows = np.random.default_rng(width), []
    for g in range(12):  # groups of copies with more and more words changed, so that chains and open pairs appear
        base = words(100 + g, 60 + 20 * g)
        for k in range(14):
            w = list(base)
            for p in rng.integers(0, len(w), k if g % 2 else 1 + len(w) // 18):
                w[p] = f"w{rng.integers(1000)}"
            rows.append((len(rows) * 3, " ".join(w)))
    rows += [(5000, "Only"), (5001, "only"), (5003, ""), (5004, None), (5006, " \t")]
    want = brute_components(rows, width)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n, r.component) for r in neardup.linked(shuffled(docs), width=width).collect()}
    assert got == want


def test_near_duplicates_on_edge_rows(edges):
    out = neardup.near_duplicates(edges)
    assert out.columns == [*edges.columns, "n_shingles", "component_id", "kept"] and out.count() == edges.count()
    kept = as_rows(out, "doc_id", "kept")
    assert kept[1, True] == 1 and kept[3, False] == 1 and kept[4, False] == 2 and kept[2, True] == 2 and kept[None, True] == 2 and kept[6, True] == 1


def test_representatives_are_the_kept_rows(edges):
    kept = neardup.near_duplicates(edges).where("kept").select(*edges.columns)
    assert as_rows(neardup.representatives(edges), "*") == as_rows(kept, "*")
    assert neardup.representatives(edges.limit(0)).count() == 0


def test_sketch_estimates_similarity(spark):
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    b = np.unique(np.concatenate([a[:800], rng.integers(0, 2**63, 100).astype(np.uint64)]))
    real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    sketches = neardup.odd_sketch(np.concatenate([a, b]), np.array([len(a), len(b)]), neardup.FINE_SAMPLES, neardup.FINE_BITS).view(np.int64).tolist()
    est = spark.createDataFrame([tuple(sketches)], "a array<long>, b array<long>").select(neardup.sketch_similarity(F.col("a"), F.col("b"), neardup.FINE_SAMPLES, neardup.FINE_BITS)).first()[0]
    assert abs(est - real) < 0.04


# --- classifier


def test_classifier_learns_and_never_sees_held_out_labels(spark):
    rng, rows = np.random.default_rng(4), []
    for i in range(400):
        good = i % 3 > 0
        rows.append((i, " ".join("".join(rng.choice(list("abcde" if good else "vwxyz"), 5)) for _ in range(60)), int(good)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2] if zlib.crc32(str(r[0]).encode()) % 3 != 1 else 1 - r[2]) for r in rows] + [(1000, None)], "doc_id long, quality int")
    model = classifier.fit(docs, labels)
    out = classifier.score(shuffled(docs), model).collect()
    truth = {r[0]: r[2] for r in rows}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert np.mean([r.predicted == truth[r.doc_id] for r in out if r.doc_id in truth]) > 0.97
    held = {r.doc_id for r in docs.where(classifier.held_out("doc_id")).collect()}
    assert held == {i for i in [*truth, 1000] if zlib.crc32(str(i).encode()) % 3 == 1}


# --- shared helpers


def test_span_hash_names_spans_by_content():
    t = C.texts_of(pa.array(["ab ab cab", None, "", "ab"]))
    start, end = C.spans(~C.byte_class((0x20, 0x20), (0x0A, 0x0A))[t.buf])
    h = C.span_hash(t.buf, start, end)
    assert h[0] == h[1] == h[3] != h[2] and C.owner(t.end, start).tolist() == [0, 0, 0, 3]


def test_pieces_keep_all_rows_in_order():
    batch = pa.record_batch([pa.array(["x" * n for n in (3, 900, 0, 5, 5)] + [None])], ["text"])
    got = list(C.pieces(iter([batch]), "text", 10))
    assert [p.num_rows for p in got] == [1, 1, 4] and pa.Table.from_batches(got).to_pydict() == pa.Table.from_batches([batch]).to_pydict()


def test_digests_of_the_registered_queries(spark):
    """The queries' digest columns are those of the operators' results."""
    from zonometry.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op5_byte_bpe"](spark, sf).collect():
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    want = removed_bytes(list(text.items()), suffixes.WIDTH)
    for r in QUERIES["op3_suffix_array_dedup"](spark, sf).collect():
        gone, b = want[r.doc_id, text[r.doc_id]], text[r.doc_id].encode()
        assert (r.n_removed, r.n_spans) == (sum(gone), len(re.findall(b"\1+", bytes(gone))))
        assert r.kept_sha256 == hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()
    found = brute_components(list(text.items()), 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op7_minhash_odd_sketch"](spark, sf).collect()} == found
