"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenvec.llm import chat, html_text, license_scan, line_dedup, mixing, packing, quality_model, quality_rules, simhash, vector_dedup
from lumenvec.llm.common import components

LONG = "word " * 30_000
ODD = [None, "", " \n\t", "one", "a b c d", LONG, LONG + "x", "é ü 日本 😀 " * 9, "a b c d", None]


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(0)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 101 + i) for i in range(50)]
    pairs = [*chain, *star, (7, 7), *[tuple(map(int, rng.integers(200, 260, 2))) for _ in range(45)]]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for n in got}
    assert set(got) == {n for n in root if find(n) != n}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(spark, docs_of):
    rows = simhash.near_duplicates(docs_of(ODD)).collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ODD)
    assert [out[k]["component_id"] for k in (0, 1, 2, 9)] == [0] * 4 and out[0]["fp"] == 0
    assert out[8]["component_id"] == 4 and out[6]["component_id"] == 5
    again = simhash.near_duplicates(docs_of(["x y z", "x y z", "q"], ids=[None, 3, 3])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in again} == {(None, 3), (3, 3)} and len(again) == 3
    assert simhash.near_duplicates(docs_of(ODD).filter("false")).count() == 0
    kept = simhash.keep_one(docs_of(ODD))
    assert kept.columns == docs_of(ODD).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 5, 7]


def test_simhash_grid_of_a_hot_anchor(spark):
    """A dense group of fingerprints gives the same components in cells of any size."""
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 1 << 62))
    fps = {base}
    while len(fps) < 300:
        fps.add(base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 7)), replace=False)))
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 200)}
    rows = [(int(np.array(f, np.uint64).view(np.int64)), k) for k, f in enumerate(sorted(fps))]
    f = np.array(sorted(fps), np.uint64)
    root = list(range(len(f)))
    for a, b in zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f) <= 4), strict=True):
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    want = {k: top(k) for k in range(len(f)) if top(k) != k}
    table = spark.createDataFrame(rows, "fp long, node long")
    for options in ({}, {"rows_per_cell": 8, "cols_per_cell": 16}, {"paired": True}, {"paired": True, "rows_per_cell": 8, "cols_per_cell": 16}):
        got = {r["node"]: r["root"] for r in components(simhash.links(table, 4, **options)).collect()}
        assert got == want


def test_simhash_sparse_links_at_crowded_anchors(spark):
    """Few links at anchors of many fingerprints: those of rows and columns in different cells count too."""
    rng = np.random.default_rng(5)
    pairs = []
    for _ in range(150):  # the two differ by two bits of each later block, so they meet in the first one, which all share
        bits = rng.integers(0, 2, 64)
        other = bits.copy()
        other[22 + rng.choice(21, 2, replace=False)] ^= 1
        other[43 + rng.choice(21, 2, replace=False)] ^= 1
        pairs += [bits, other]
    bits = np.array(pairs)
    bits[:, :22] = 0
    fps = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel().tolist()
    links = simhash.Labels(len(bits))
    links.merge(*np.nonzero((bits[:, None] != bits).sum(2) <= 4))
    want = {k: root for k, root in enumerate(links.root.tolist()) if root != k}
    assert len(want) >= 150
    table = spark.createDataFrame(list(zip(fps, range(len(fps)), strict=True)), "fp long, node long")
    for options in ({}, {"rows_per_cell": 60, "cols_per_cell": 60}, {"rows_per_cell": 150, "cols_per_cell": 150}, {"paired": True}):
        got = {r["node"]: r["root"] for r in components(simhash.links(table, 4, **options)).collect()}
        assert got == want


def _edited(rng, words, edits):
    other = list(words)
    for at in rng.choice(len(words), edits, replace=False):
        other[at] = "other"
    return other


def _jaccard(texts):
    sets = [set(simhash.bag(simhash.shingles((t or "").encode(), 5)).tolist()) for t in texts]
    return np.array([[len(a & b) / max(1, len(a | b)) for b in sets] for a in sets])


def test_keep_one_goes_by_jaccard(spark, docs_of):
    """Pairs of five-word shingles at 0.8 or more are linked, none below; large groups too."""
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(60):
        words = [f"w{k}" for k in rng.integers(0, 10**9, 120)]
        texts += [" ".join(words), " ".join(_edited(rng, words, int(rng.integers(1, 8))))]
    for edits in (1, 3, 5):  # groups that a star from their middle connects, in part, and not at all
        words = [f"v{k}" for k in rng.integers(0, 10**9, 110)]
        texts += [" ".join(_edited(rng, words, edits)) for _ in range(40)]
    texts += ["again and again we meet here " * 5, "again and again we meet here " * 6, None, ""]
    common = _jaccard(texts)
    labels = simhash.Labels(len(texts))
    labels.merge(*np.nonzero(common >= 0.8))
    labels.merge(np.array([len(texts) - 2]), np.array([len(texts) - 1]))
    assert ((common > 0.6) & (common < 0.8)).any()
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs_of(texts)).collect()}
    assert got == dict(enumerate(labels.root.tolist()))
    assert {r["doc_id"] for r in simhash.keep_one(docs_of(texts)).collect()} == {k for k, root in got.items() if k == root}


def test_close_finds_all_and_leaves_unlike_pairs_early(monkeypatch):
    """Unlike pairs cost three words each, not all their bits again; by size most are not looked at. No pair is lost."""
    rng = np.random.default_rng(12)
    n = np.sort(np.exp(rng.normal(5, 1, 1200)).astype(np.int64) + 1)
    fps = rng.integers(0, 2**63, (1200, 4)).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, (1200, 4)).astype(np.uint64)
    for k in range(0, 1200, 3):  # near ones, of sizes like enough and not; from 0 bits to beyond the limit
        other = min(1199, k + int(rng.integers(1, 120)))
        flips = np.packbits(np.arange(256) < rng.integers(0, 80)).view(np.uint64)
        fps[other] = fps[k] ^ flips
    fps[5] = ~fps[4]  # 256 differing bits
    most, least = simhash.SIMILAR_BITS, simhash.SIMILAR
    apart = np.bitwise_count(fps[:, None] ^ fps).sum(2, dtype=int)
    near = (apart <= most) & (np.minimum(n[:, None], n) >= least * np.maximum(n[:, None], n))
    at, half = np.arange(1200), np.flatnonzero(rng.random(1200) < 0.5)
    count, looked = np.bitwise_count, []
    monkeypatch.setattr(np, "bitwise_count", lambda x: looked.append(x.size) or count(x))
    for rows, cols in ((at, at), (half, at), (half, np.setdiff1d(at, half[::2])), (half[:0], at), (at, half[:0])):
        want = {(min(i, j), max(i, j)) for i in rows.tolist() for j in cols.tolist() if i != j and near[i, j]}
        pairs = len(rows) * len(cols) / (1 if len(rows) != len(cols) else 2)
        for more, words in (({}, 3), ({"by_size": True}, 1)):
            looked.clear()
            got = [p for i, j in simhash._close(fps, n, rows, cols, most, least, 1 << 16, **more) for p in zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), strict=True)]
            assert set(got) == want and (rows is not cols or len(got) == len(want))
            assert sum(looked) <= 1.1 * words * pairs


def test_recall_just_above_the_limit():
    """Share of pairs at a similarity of 0.80 to 0.84 that meet and differ in few enough bits."""
    rng = np.random.default_rng(8)
    met = n = 0
    while n < 300:
        words = [f"w{k}" for k in rng.integers(0, 10**9, int(rng.integers(150, 600)))]
        other = _edited(rng, words, max(1, len(words) // 48))
        a, b = (simhash.shingles(" ".join(w).encode(), 5) for w in (words, other))
        share = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        if not 0.8 <= share < 0.84:
            continue
        n += 1
        fps = np.array([simhash._fold(a, simhash.SIMILAR_HALVES), simhash._fold(b, simhash.SIMILAR_HALVES)], np.uint64)
        if np.bitwise_count(fps[0] ^ fps[1]).sum() > simhash.SIMILAR_BITS:
            continue
        met += any(set(anchor[index == 0].tolist()) & set(anchor[index == 1].tolist()) for index, anchor, _ in simhash.anchors(list(fps.T.copy()), simhash.SIMILAR_DIFFER))
    print("recall", met / n)
    assert met / n >= 0.97


def test_quality_rules(spark, docs_of):
    docs = docs_of([*ODD, "The cat of the house and the dog. " * 2 + "It was in a tree by the road, and he saw it with his own eyes."])
    rows = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert len(rows) == len(ODD) + 1
    assert rows[0]["n_words"] == 0 and rows[0]["base_failed"] and not rows[0]["kept"]
    assert rows[5]["n_repeat_words"] == 30_000
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["kept"]}
    assert quality_rules.filter_documents(docs_of([*ODD, "The cat of the house and the dog had a bone. It was in a tree by the road, and he saw it with his own eyes."])).count() == 1
    assert quality_rules.judge(docs.filter("false")).count() == 0
    clashing = docs.withColumnsRenamed({"_row": "kept", "fp": "_w", "target": "n_words", "_id": "_hold"})
    judged = quality_rules.judge(clashing)
    assert {r["doc_id"]: (r["n_words"], r["kept"], r["_w"]) for r in judged.collect()} == {i: (r["n_words"], r["kept"], "f") for i, r in rows.items()}
    passed = quality_rules.filter_documents(clashing)
    assert passed.columns == clashing.columns and {(r["doc_id"], r["kept"], r["n_words"]) for r in passed.collect()} == {(i, f"r{i}", "t") for i, r in rows.items() if r["kept"]}


def test_line_dedup_templates(spark, docs_of):
    own = ["alone here", "the second one stands by itself", "third of all", "a fourth text", "number five says that", "last"]
    varied = [f"posted on the forum by {name} in spring" for name in "ann bob cid dan eve fay".split()]
    dated = [f"page {k} of 99" for k in range(6)]
    docs = docs_of(["\n".join(x) for x in zip(own, varied, dated, strict=True)] + [None, "", "solo"])
    got = {r["doc_id"]: r for r in line_dedup.drop_lines(docs).collect()}
    assert got[0]["text"] == "\n".join((own[0], varied[0], dated[0]))
    assert [got[k]["text"] for k in range(1, 6)] == own[1:] and got[3]["n_dropped_lines"] == 2
    assert got[6]["text"] is None and got[7]["text"] == "" and got[8]["text"] == "solo"
    assert line_dedup.drop_lines(docs).columns == [*docs.columns, "n_dropped_lines"]
    forum = docs_of([f"{t}\nposted on the forum by {x} in the early spring" for t, x in zip(own, "ann ann ann bob cid".split(), strict=False)])
    assert [r["n_dropped_lines"] for r in sorted(line_dedup.drop_lines(forum).collect())] == [0, 1, 1, 1, 1]
    clashing = docs_of(["a b c\nown", "a b c", "a b c"]).withColumnsRenamed({"_row": "n_dropped_lines", "fp": "_drop", "_id": "k1"})
    assert sorted((r["doc_id"], r["text"], r["n_dropped_lines"], r["_drop"]) for r in line_dedup.drop_lines(clashing).collect()) == [(0, "a b c\nown", 0, "f"), (1, "", 1, "f"), (2, "", 1, "f")]
    assert [tuple(r) for r in line_dedup.filter_documents(clashing).collect()] == [tuple(clashing.first())]
    assert line_dedup.filter_documents(docs_of(ODD)).count() == len(ODD)
    assert line_dedup.drop_lines(docs.filter("false")).count() == 0
    twice = docs_of(["same line here"] * 3, ids=[1, 1, 1])
    assert line_dedup.drop_lines(twice).filter("n_dropped_lines > 0").count() == 0
    assert line_dedup.drop_lines(docs_of(ODD, ids=[None] * len(ODD))).filter("n_dropped_lines > 0").count() == 0


def test_mixing(spark, docs_of):
    docs = docs_of([*ODD, "w " * 900], sources=[None, "a", "b", "b", None, "a", "a", "c", "b", "", "d"])
    rows = mixing.shares(docs).collect()
    assert len(rows) == 11 and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows), rel=0.02)
    assert mixing.shares(docs.filter("false")).count() == 0
    assert mixing.shares(docs_of([None, ""])).agg({"taken": "sum"}).first()[0] == 0
    same = docs_of(["p q r"] * 4, sources=["s"] * 4, ids=[1, 1, None, None])
    assert sorted(r["size"] for r in mixing.shares(same).collect()) == [3] * 4
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs.filter("false")).count() == 0 and mixing.mixed(docs_of([None, ""])).count() == 0
    # Repeated rows and ids: as many copies as their places are taken.
    texts = ["u v w " * 100] * 30 + ["x y z " * 100] * 30
    many = docs_of(texts, sources=["s"] * 60, ids=[1] * 30 + list(range(31)[1:]))
    wanted = sum(round(r["taken"] / 300) for r in mixing.shares(many).collect())
    assert abs(mixing.mixed(many).count() - wanted) <= 1 and wanted == 90


def test_mix_is_in_the_schedules_order(spark, docs_of):
    """Any stretch of the output holds the sources near their weights."""
    sources = [f"s{k % 3}" for k in range(3000)]
    out = mixing.mixed(docs_of([f"d{k} " + "w " * 99 for k in range(3000)], sources=sources)).select("source").collect()
    total = {s: sum(r["source"] == s for r in out) for s in ("s0", "s1", "s2")}
    assert len(out) == pytest.approx(4500, abs=10)
    for low in range(0, len(out) - 500, 250):
        for s, n in total.items():
            assert abs(sum(r["source"] == s for r in out[low : low + 500]) - 500 * n / len(out)) <= 12


def test_mixing_with_map_columns(spark, docs_of):
    """Maps, inside other types too, have no hash of their own; rows that differ in them alone are told apart."""
    docs = docs_of(["a b c d"] * 4, ids=[1, 1, 2, 3]).withColumn("meta", F.create_map(F.lit("k"), F.monotonically_increasing_id()))
    docs = docs.withColumn("deep", F.array(F.struct(F.col("meta").alias("m"))))
    plain, with_maps = (sorted(map(tuple, mixing.shares(d, slot_words=2).select("doc_id", "size", "taken").collect())) for d in (docs.drop("meta", "deep"), docs))
    assert plain == with_maps
    mixed = mixing.mixed(docs, slot_words=2)
    assert mixed.columns == docs.columns
    assert 0 < len(mixed.select("doc_id", F.to_json("meta").alias("meta")).distinct().collect()) <= 4
    assert mixing.mixed(docs.filter("false")).count() == 0


def test_targets_reshare_by_weight(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), ("d", 5000), (None, 70)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    weight, cap = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {"a": 200, "b": 2000, "c": 20, "d": 10000, None: 140}
    total, want, open_ = 1.5 * 6180, {}, set(weight)
    while True:
        rest = total - sum(want.values())
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap[s]}
        if not over:
            want |= share
            break
        want |= {s: cap[s] for s in over}
        open_ -= over
    assert got == pytest.approx(want)


def test_vectors(spark):
    inf, nan = math.inf, math.nan
    rows = [
        (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, 0.1], 0), (4, [0.0, 0.0], 0), (5, None, 0), (6, [1.0, None], 0), (7, [nan, 1.0], 0),
        (8, [inf, 1.0], 0), (9, [1.0, 0.0], None), (10, [1.0, 0.0], 1), (None, [1.0, 0.0], 0), (11, [1.0], 0), (2, [1.0, 0.0], 0), (12, [], 0),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1, r["kept"]) for r in vector_dedup.near_duplicates(table).collect())
    assert got == sorted([
        (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False), *[(k, 0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11, 12)], (-1, 0, -1, False),
    ])
    assert vector_dedup.near_duplicates(table.filter("false")).count() == 0
    clashing = table.withColumns({c: F.lit("x") for c in ("v", "h", "node", "kept", "n_links")})
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1, r["kept"]) for r in vector_dedup.near_duplicates(clashing).collect()) == got


def test_vectors_at_the_threshold(spark):
    """Pairs within the bound of the threshold go by the double product, in sparse and in dense tiles."""
    rng = np.random.default_rng(2)
    base = np.eye(8)[0]
    rows = []
    for k in range(400):
        side = rng.normal(size=8)
        side[0] = 0
        c = 0.93 + rng.normal() * 1e-4 if k % 2 else 0.93
        rows.append(c * base + math.sqrt(max(0.0, 1 - c * c)) * side / np.linalg.norm(side))
    x = np.array([base, *rows])
    table = spark.createDataFrame([(k, [float(v) for v in row], 0) for k, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
    products, lengths = np.einsum("ik,jk->ij", x, x), np.einsum("ik,ik->i", x, x)
    links = products / np.sqrt(lengths[:, None] * lengths) >= 0.93
    for tile in (64, 4096):
        got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicates(table, tile=tile).collect()}
        assert got == {k: int(links[k].sum()) - 1 for k in range(len(x))}


def test_vectors_tiles_agree(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 16))
    x = base[rng.integers(0, 20, 300)] + 0.22 * rng.normal(size=(300, 16))
    table = spark.createDataFrame([(k, [float(v) for v in row], k % 2) for k, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.93) & (np.arange(300)[:, None] % 2 == np.arange(300) % 2)
    for tile in (16, 2048):
        got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicates(table, tile=tile).collect()}
        assert got == {k: int(links[k].sum()) - 1 for k in range(300)}


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 40))
def test_quantisation_bound_holds(seed, dim):
    rng = np.random.default_rng(seed)
    u = vector_dedup._unit(rng.normal(size=(12, dim)) ** 3)
    codes, scale, length, error = vector_dedup.quantise(u)
    near = vector_dedup._product(codes, codes) * (scale[:, None] * scale)
    assert (np.abs(u @ u.T - near) <= length[:, None] * error + error[:, None] * (length + error) + 1e-12).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "### x", ""]), st.text(alphabet=st.sampled_from(list("#\\</turn> aé\n:😀")), max_size=30)), max_size=6))
def test_chat_round_trip(turns):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    a = chat.Assembly(path)
    for role, text in turns:
        a.add(role, text)
    assert chat.read_turns(a.ids, path) == turns
    assert "".join(chat.read_loss(np.array(a.ids), a.mask(), path)) == "".join(t for r, t in turns if r == "assistant")
    assert all(chat.unescape(chat.escape(t)) == t for _, t in turns)


def test_chat_edges(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 1, None, "x"), (None, 0, "assistant", "a"), (1, 1, None, "x"), (None, None, "user", "")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_conversations(rows).collect()}
    assert got[1]["n_turns"] == 3
    alone = [(r["n_turns"], r["text"]) for r in chat.format_conversations(rows).collect() if r["conv_id"] is None]
    assert sorted(alone) == [(1, "### assistant: a </turn>\n"), (1, "### user:  </turn>\n")]
    clashing = rows.withColumns({"ids": F.lit(1), "n_turns": F.lit("x"), "_salt": F.lit(2)})
    assert sorted(map(str, chat.format_conversations(clashing).collect())) == sorted(map(str, chat.format_conversations(rows).collect()))
    long = spark.createDataFrame([(k // 5, k, "assistant", "a b " * 20_000) for k in range(10)], rows.schema)
    assert [len(r["loss_mask"]) > 200_000 for r in chat.format_conversations(long).collect()] == [True, True]
    with pytest.raises(Exception, match="tokens"):
        chat.format_conversations(long, most_tokens=100_000).collect()
    assert chat.format_conversations(rows.filter("false")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40))
def test_packing_is_whole_and_full(lengths):
    found = packing.assign(lengths, 16)
    covered = {}
    for pieces in found:
        total = sum(n for _, _, n in pieces)
        assert total == 16 or total & (total - 1) == 0
        for doc, start, n in pieces:
            covered.setdefault(doc, []).append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, size in sorted(covered[doc]):
            assert start == at and size > 0
            at += size
        assert at == n


def slow_assign(lengths, capacity):
    """Number of pieces cut, choosing among all sequences for each piece."""
    total = sum(lengths)
    pieces = sorted((n % capacity for n in lengths if n % capacity), reverse=True)
    rooms = [[0.0, capacity] for _ in range(total // capacity - sum(n // capacity for n in lengths))]
    rooms += [[0.0, 1 << b] for b in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> b & 1]
    cut = 0
    for n in pieces:
        fit = [r for r in rooms if r[1] >= n]
        if not fit:
            cut += 1
            continue
        best = min(fit, key=lambda r: r[0])
        best[0] += packing.cost(n, 1.0, 1 / 1024)
        best[1] -= n
    return cut


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=200))
def test_packing_cuts_only_what_fits_nowhere(lengths):
    found = packing.assign(lengths, 64)
    whole = {}
    for pieces in found:
        for doc, _, n in pieces:
            whole.setdefault(doc, []).append(n)
    cut = sum(len(parts) > n // 64 + (n % 64 > 0) or (n % 64 > 0 and n % 64 not in parts) for n, parts in ((lengths[d], p) for d, p in whole.items()))
    assert cut <= slow_assign(lengths, 64)


def test_word_encoder_equals_tokenizer():
    import public_tokenizers

    e = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), generation=5)
    texts = ["", "  a\tb ", "Don't  WE'LL 12a3b <|endoftext|>x y<|startoftext|>", "Éá ΣΑΣ", "x\x00y \x1cq\x1d z w", "naïve—“q” 日本語 😀", "a\u0085b", "İstanbul ß ſ K", "that' it's ab's a1 1' ''", "que, Éte. l'été ŉx ª º µ"] * 2
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_packing_edges(spark, docs_of):
    rows = packing.pack(docs_of(ODD)).collect()
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        assert len(r["ids"]) == r["length"]
    assert total[0] == total[1] == total[2] == 1 and total[5] == 30_001 and len(total) == len(ODD)
    assert packing.pack(docs_of(ODD).filter("false")).count() == 0
    clashing = docs_of(ODD).withColumns({"start": F.lit("x"), "ids": F.lit("y"), "sequence_id": F.lit("z")})
    assert sorted(packing.pack(clashing).collect()) == sorted(rows)


def test_classifier_edges(spark, docs_of):
    good, bad = "the cat sat on the mat and was happy", "%%% $$$ &&& ### !!! %%% $$$"
    docs = docs_of([*[good, bad] * 12, *ODD])
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(24)] + [(None, 1), (3, None)], "doc_id long, quality int")
    scores = {r["doc_id"]: r["score"] for r in quality_model.score(docs, quality_model.fit(docs, labels)).collect()}
    assert scores[0] > 0.5 > scores[1] and len(scores) == 24 + len(ODD) and scores[24] == scores[25]
    none = quality_model.fit(docs, labels.filter("false"))
    assert {r["score"] for r in quality_model.score(docs, none).collect()} == {0.5}
    assert quality_model.score(docs.filter("false"), none).count() == 0


def test_scorer_against_plain_sums():
    """The cached scorer gives what the mean of all feature vectors gives."""
    rng = np.random.default_rng(1)
    model = quality_model.Model(rng.normal(size=quality_model.BUCKETS).astype(np.float32), 0.3)
    texts = [b"", b" \n", b"a a a b", "été à la plage, l'été".encode(), b"x" * 5000, "日本語 テスト 日本語 日本語".encode(), b"one two two three " * 400]
    scorer = quality_model.Scorer(model, most_known=3)
    for _ in range(2):
        got = scorer.scores(texts)
        for text, score in zip(texts, got, strict=True):
            at, share = quality_model.document_features(text)
            assert score == pytest.approx(1 / (1 + math.exp(-(model.bias + float((model.values[at] * share).sum())))))
    buckets, owner = quality_model.word_features(["é".encode()])
    assert len(buckets) == 1 + 2 + 1 and set(owner.tolist()) == {0}  # the word, two pairs and a triple of code points


def test_training_rows_are_bounded(spark, docs_of):
    docs = docs_of(["good text here"] * 50 + ["w " * 50_000] * 3, ids=[1] * 50 + [2, 3, 4])
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)] * 2, "doc_id long, quality int")
    taken = quality_model.training_rows(docs, labels, most=5, most_chars=1000)
    assert taken.num_rows <= 5 and max(len(t.as_py()) for t in taken.column("text")) <= 1000


def test_license_edges(spark, docs_of):
    text = "intro words\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright\nnotice and this permission notice appear in all copies.\nend"
    docs = docs_of([*ODD, text, "version 4 of the GNU General Public License", "this work is licensed under the gnu general public license, version 3!"])
    rows = license_scan.scan(docs).collect()
    assert [(r["doc_id"], r["license"], r["differing_words"]) for r in sorted(rows)] == [(10, "ISC", 0), (12, "GPL-3.0-only", 0)]
    assert all(text[r["start"] : r["start"] + r["length"]] == r["wording"] for r in rows if r["doc_id"] == 10)
    assert license_scan.scan(docs.filter("false")).count() == 0


def test_html_held_out_pages():
    model = html_text.trained()
    held = html_text.labelled_pages(150, seed=1234)
    assert np.mean([model.text(page) == main for page, main in held]) > 0.85


def test_html_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    parent = np.array([-1, 0, 0, 1, 1, 2])
    unary, edge = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
    node, pair = html_text.passes(unary, parent, edge)
    total, want = 0.0, np.zeros((6, 2))
    for state in np.ndindex(*[2] * 6):
        w = math.exp(sum(unary[k, s] for k, s in enumerate(state)) + sum(edge[state[parent[k]], state[k]] for k in range(1, 6)))
        total += w
        for k, s in enumerate(state):
            want[k, s] += w
    assert np.allclose(node, want / total) and np.allclose(pair[1:].sum((1, 2)), 1)


def test_html_edges(spark):
    body = "<article><h1>T</h1><p>One &lt;two&gt;\n three.<p>Four <b>five.</article><footer>&copy; x</footer>"
    rows = [(1, "u", None), (2, "u", ""), (3, None, body), (4, "u", "<p>" + "long sentence here. " * 20_000), (5, "u", "<<<>>><script>x"), (3, None, body)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    out = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 6 and out[1] == out[2] == "" and out[3] == "T\nOne <two> three.\nFour five."
    clashing = spark.createDataFrame([(1, "u", body, "x", "y")], "page_id long, url string, html string, text string, n_chars string")
    assert [r["text"] for r in html_text.extract(clashing).collect()] == [out[3]]
    assert html_text.extract(clashing.filter("false")).count() == 0


HARD = {
    "unclosed tags": "<a" * 10**6, "unclosed values": '<a b="' * 10**5, "odd quotes": "<p c='x>" * 10**5, "one tag of 10 MB": "<p " + "x=y " * (25 * 10**5) + ">text here.",
    "deep": "<div>" * 10**5 + "deep text.", "stray ends": "<x>" * 10**5 + "</y>" * 10**5, "items below many": "<li><ul>" + "<q1>" * 10**5 + "<li>a</li>" * 10**5,
    "long numbers": "&#" + "9" * 10**6 + "; &#x" + "f" * 10**5 + " &#00000000065;", "comments": "<!--" * 10**5, "scripts": "<script>" * 10**5, "signs": "<" * 10**6,
    "long name": '<p class="' + "advert_" * 10**5 + '">x', "spaces": "<p a" + " " * 10**6 + "=>x", "cells": "<table><tr>" + "<td>x" * 10**5,
}


@pytest.mark.parametrize("name", sorted(HARD))
def test_html_parser_takes_linear_time(name):
    import time

    began = time.perf_counter()
    html_text.parse(HARD[name])
    assert time.perf_counter() - began < 4


def test_html_parser_mends_markup():
    def shape(page):
        return [(n.tag, n.parent, n.text) for n, _ in html_text.parse(page)][1:]

    assert shape("<ul><li>a<li>b<ul><li>c</ul></ul>") == [("ul", 0, ""), ("li", 1, ""), ("#text", 2, "a"), ("li", 1, ""), ("#text", 4, "b"), ("ul", 4, ""), ("li", 6, ""), ("#text", 7, "c")]
    assert shape("<table><tr><td>x<td>y<tr><td>z</table>") == [("table", 0, ""), ("tr", 1, ""), ("td", 2, ""), ("#text", 3, "x"), ("td", 2, ""), ("#text", 5, "y"), ("tr", 1, ""), ("td", 7, ""), ("#text", 8, "z")]
    assert shape('<p title="a>b">c<p d\'>e') == [("p", 0, ""), ("#text", 1, "c"), ("p", 0, ""), ("#text", 3, "e")]
    assert shape("&#65;&#x42;&#0000067;&#99999999999;&nope;") == [("#text", 0, "ABC\ufffd&nope;")]
