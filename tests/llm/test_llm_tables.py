"""Sharding, URL filter, transcripts, components and the pipeline against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import shuffled, text
from pyspark.sql import functions as F

from zonometry.llm import bloom, components, hilbert, transcripts, urls
from zonometry.llm.queries import QUERIES, RULES

SF = "/root/testdata/sf0.001"


# --- sharding


@pytest.mark.parametrize("axes, bits", [(2, 3), (3, 2), (4, 2), (1, 3), (3, 1)])
def test_hilbert_index_is_a_walk_of_unit_steps(spark, axes, bits):
    mask = (1 << bits) - 1
    point = [F.shiftright("id", bits * k).bitwiseAND(F.lit(mask)).cast("int") for k in range(axes)]
    rows = spark.range(1 << bits * axes).select(F.array(*point).alias("p"), hilbert.hilbert_index(point, bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << bits * axes))
    assert all(sum(abs(a - b) for a, b in zip(x.p, y.p)) == 1 for x, y in zip(rows, rows[1:]))


def test_shards_hold_equal_counts_and_gapless_slots(spark):
    rows = [(None if i % 50 == 0 else i // 2, ["a", "b", None][i % 3], 10 if i % 4 else i) for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    dims = {"source": hilbert.text_code(F.col("source")), "size": hilbert.number_code(F.col("size")), "doc_id": hilbert.number_code(F.col("doc_id"))}
    out = hilbert.curve_shards(shuffled(df), dims, 40, ["doc_id", "source", "size"])
    slots = defaultdict(list)
    for r in out.collect():
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(40)) and {len(v) for v in slots.values()} <= {25, 26}
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert Counter(tuple(r) for r in out.select("doc_id", "source", "size").collect()) == Counter(rows)


def test_shards_follow_the_curve_and_prune(spark):
    df = spark.range(4096).select((F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"))
    out = hilbert.curve_shards(df, {"x": hilbert.number_code(F.col("x")), "y": hilbert.number_code(F.col("y"))}, 16, ["x", "y"])
    ordered = out.orderBy("shard", "slot").collect()
    assert [r.curve for r in ordered] == sorted(r.curve for r in ordered)
    ranges = hilbert.shard_ranges(out, ["x", "y"]).collect()
    assert sum(r.x_min <= 5 <= r.x_max for r in ranges) <= 6 and sum(r.y_min <= 50 <= r.y_max for r in ranges) <= 6


def test_slices_of_a_cell_keep_ranks(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "SLICE_ROWS", 50)
    df = spark.range(500).withColumn("same", F.lit(1))
    out = hilbert.curve_shards(df, {"same": hilbert.number_code(F.col("same"))}, 7, ["id"]).collect()
    assert max(Counter(r.shard for r in out).values()) - min(Counter(r.shard for r in out).values()) <= 1
    assert len({(r.shard, r.slot) for r in out}) == 500


def test_shards_of_nothing_and_clashing_names(spark):
    none = spark.createDataFrame([], "x long")
    assert hilbert.curve_shards(none, {"x": hilbert.number_code(F.col("x"))}, 3, ["x"]).count() == 0
    with pytest.raises(ValueError, match="slot"):
        hilbert.curve_shards(spark.range(3).withColumn("Slot", F.lit(1)), {"id": hilbert.number_code(F.col("id"))}, 3, ["id"])


def test_written_shards_read_back(spark, tmp_path):
    df = spark.range(100).withColumn("k", F.col("id") % 7)
    out = hilbert.curve_shards(df, {"k": hilbert.number_code(F.col("k"))}, 4, ["id"])
    hilbert.write_shards(out, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 100 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_op2_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op2_hilbert_shards"](spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter(docs.keys())
    n, ordered = len(rows), sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.shard for r in ordered] == [k * 40 // n for k in range(n)] and [r.curve for r in ordered] == sorted(r.curve for r in ordered)
    for r in rows:
        b = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 16, zlib.crc32(b), "rows", None)


# --- URL filter


def test_url_parts_and_rules(spark):
    cases = {
        "http://A.Example.ORG/es/x?q=/en/1#f": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "https://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"), "https://x.com/de/1": ("x.com", "/de/1", "com/de/", "block"),
        "https://com/de/": ("com", "/de/", "com/de/", "block"), "ftp://x.org": ("x.org", "", None, "allow"), "//x.org/": ("", "", None, "allow"),
        "a://b?c://d/e": ("b", "", None, "allow"), "É://ÉA.net/É/?": ("Éa.net", "/É/", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(cases)], "page_id long, url string, listed_by string")
    none = spark.createDataFrame([], "url string")
    got = urls.filter_urls(pages, none, RULES).collect()
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in got} == cases and not any(r.listed for r in got)


def test_listed_urls_are_caught_by_any_address_and_no_other(spark):
    pages = [(i, f"https://{['www.', 'm.', ''][i % 3]}site{i // 6}.net/p{i // 6}{['', '/', '.html'][i // 2 % 3]}{['', '?u=1', '#t'][i % 3]}") for i in range(3000)]
    listed = spark.createDataFrame([(f"http://site{k}.net/p{k}",) for k in range(0, 500, 7)] * 2 + [(None,), ("",)], "url string")
    got = urls.filter_urls(shuffled(spark.createDataFrame(pages, "page_id long, url string")), listed, RULES)
    assert got.count() == 3000 and got.where("listed <> (floor(page_id / 6) % 7 = 0) or verdict <> if(listed, 'block', 'allow')").count() == 0


def test_bloom_filter_passes_all_keys_and_few_others(spark):
    keys = spark.range(2000).select((F.col("id") * 7).alias("k"))
    blocks, n = bloom.build(keys, "k")
    got = bloom.probe(spark.range(14000).withColumnRenamed("id", "k"), "k", blocks, n, "may").groupBy((F.col("k") % 7 == 0).alias("in"), "may").count().collect()
    count = {(r["in"], r.may): r["count"] for r in got}
    assert (True, False) not in count and count.get((False, True), 0) < 300


def test_url_filter_refuses_clashing_names(spark):
    with pytest.raises(ValueError, match="host"):
        urls.filter_urls(spark.createDataFrame([("a", "b")], "url string, host string"), spark.createDataFrame([], "url string"), RULES)


# --- components


def test_components_of_chains_stars_and_rings(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300)]
    edges += [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (120, 2))]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else top(parent[x])

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = {r.v: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: top(v) for v in parent if top(v) != v}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- transcripts


def conversation_rows():
    rows = []
    for c in range(60):
        for t in range(2 + c % 5):
            rows.append((c, t, ["user", "assistant"][t % 2], text(c * 10 + t, 6 if t % 2 == 0 else 60, 12)))
    return rows


def test_marked_roles_are_recovered(spark):
    conv = spark.createDataFrame(conversation_rows(), "conv_id long, turn long, role string, text string")
    lines = transcripts.as_lines(conv)
    model = transcripts.learn(transcripts.observed(lines))
    got = {(r.conv, r.turn, r.line): r for r in transcripts.parse(shuffled(lines.drop("role")), model).collect()}
    want = lines.collect()
    assert len(got) == len(want)
    named = {r.conv for r in want if re.match(r"(User|Assistant|Q|A): ", r.raw)}
    right = [got[r.conv, r.turn, r.line].role == r.role and got[r.conv, r.turn, r.line].opens == (r.line == 0) for r in want if r.conv in named]
    assert np.mean(right) > 0.99
    body = "".join(r.piece for _, r in sorted(got.items()) if r.conv == min(named))
    assert body.startswith("<|user|>\n") and body.endswith("<|end|>\n") and body.count("<|end|>") == len(re.findall(r"<\|(?:user|assistant|system)\|>", body))


def test_blocks_and_levels_give_the_best_path(spark, monkeypatch):
    """A conversation over many blocks and levels against plain Viterbi on the whole of it."""
    rows = [(0, t, ["user", "assistant"][t % 2], text(t, 5 + 40 * (t % 2), 12)) for t in range(90)] + [(None, 0, "user", None), (1, None, None, "Q: hi"), (1, None, None, "Q: hi")]
    lines = transcripts.as_lines(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    seen = transcripts.observed(lines)
    model = transcripts.learn(seen)
    monkeypatch.setattr(transcripts, "BLOCK_TURNS", 4)
    monkeypatch.setattr(transcripts, "FAN", 3)
    got = transcripts.parse(lines.drop("role"), model)
    assert got.count() == lines.count()
    table = seen.where("conv = '0'").orderBy("turn", "line", "body").select(*transcripts.FEATURES).toArrow()
    best = transcripts._best(transcripts._step_matrices(table, model), transcripts.START, None)
    roles = [r.role for r in got.where("conv = '0'").orderBy("turn", "line").collect()]
    assert roles == [transcripts.ROLES[s // 2] for s in best]


def test_transcripts_of_nothing(spark):
    lines = transcripts.as_lines(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert transcripts.parse(lines.drop("role"), transcripts.learn(transcripts.observed(lines))).count() == 0


# --- pipeline


def test_pipeline_stages_keep_their_word(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    out = docs
    seen = {}
    for name, apply in P.STAGES:
        step = apply(spark, out, SF)
        if name != names[-1]:
            assert step.columns == docs.columns
        step.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in out.collect()}
    kept = {r.doc_id for r in QUERIES["op6_quality_rules"](spark, SF).where("kept").collect()}
    assert set(seen["quality_rules"]) == kept
    # lines: no worded line of a document stands in an earlier one
    first = {}
    for i, r in sorted(seen["line_dedup"].items()):
        assert r.n_chars == len(r.text)
        for line in {tuple(x.split()) for x in r.text.split("\n") if len(x.split()) >= 3}:
            assert line not in first, (i, first.get(line))
            first[line] = i
    # near duplicates: those kept have no link of two-word shingles, nor of five-word ones
    for width in (2, 5):
        sets = {i: {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} for i, w in ((i, r.text.lower().split()) for i, r in seen["near_dedup"].items()) if w}
        ids = sorted(sets)
        assert not any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[:k])
    # decontamination: what went holds a benchmark window, what stayed does not
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall(r.text.lower())
        wins |= {" ".join(w[k : k + min(10, len(w))]) for k in range(max(1, len(w) - 9))}
    sizes = {len(x.split()) for x in wins}

    def dirty(t):
        w = word.findall(t.lower())
        return any(" ".join(w[k : k + n]) in wins for n in sizes for k in range(len(w) - n + 1))

    assert all(dirty(r.text) == (i not in seen["decontamination"]) for i, r in seen["near_dedup"].items())
    last = seen["byte_bpe"]
    assert set(last) == set(seen["decontamination"]) and all(r.round_trip and r.n_tokens == len(r.ids) // 4 for r in last.values())


def test_pipeline_drops_lines_and_not_the_words_between_them(spark):
    """Verse, word lists and tab-separated rows keep their own lines when they lose a shared one."""
    import corpus_pipeline as P

    foot = "all rights reserved by us"
    texts = [[foot, "first text with words"], ["rose", "red rose", foot], ["a\tb\tc", "d\te\tf", foot], [foot, " ", "\u00a0"], ["\u4e2d\u6587", "\u4e2d\u6587\u5b57", foot]]
    docs = spark.createDataFrame([(i, "\n".join(t), 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in P.line_dedup(spark, docs, SF).collect()}
    assert got == {0: "\n".join(texts[0])} | {i: "\n".join(t for t in texts[i] if t != foot) for i in (1, 2, 4)}


def test_pipeline_catches_edited_copies_and_keeps_others(spark):
    """Copies of which one word in twenty is changed or left out go, down to texts of 40 words."""
    import random

    import corpus_pipeline as P
    from conftest import words

    r, rows = random.Random(3), []
    for i in range(60):
        w = [f"{x}{r.randrange(99)}" for x in words(i, 40 + 5 * i)]
        copy = list(w)
        for at in sorted(r.sample(range(len(w)), len(w) // 20), reverse=True):
            copy[at : at + 1] = ["edited"] if r.random() < 0.5 else []
        rows += [(i, " ".join(w)), (1000 + i, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x.doc_id for x in P.near_dedup(spark, docs, SF).collect()}
    assert set(range(60)) <= kept and len(kept - set(range(60))) <= 6  # recall of 0.9


def test_last_stage_refuses_its_own_column(spark):
    import corpus_pipeline as P

    with pytest.raises(ValueError, match="round_trip"):
        P.byte_bpe(spark, spark.createDataFrame([(1, "a", True)], "doc_id long, text string, round_trip boolean"), SF)
