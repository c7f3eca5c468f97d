"""Near duplicates, repeated strings, embeddings: against brute force."""

import random

import pytest
from brute import embedding_links, near_duplicates, remove_repeats, sha

from twinstage.llm import embed, minhash, suffix
from twinstage.llm.common import components

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def some_docs(spark):
    """The small table and planted cases: nulls, empty, repeats of a row, one-word and very long texts."""
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    extra = [(-1, None), (-2, ""), (-3, " \n\t"), (-4, "word"), (-5, "word"), (-6, "Word"), (-7, "one two"), (-7, "one two"),
             (None, "one two"), (None, None), (9001, long_text), (9002, long_text + " tail"), (9003, "x" * 200 + long_text[:5000])]
    return d.union(spark.createDataFrame(extra, "doc_id long, text string"))


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(spark, shingle):
    d = some_docs(spark)
    rows = [tuple(r) for r in d.collect()]
    want = sorted(near_duplicates(rows, shingle), key=str)
    got = minhash.near_duplicates(d, shingle=shingle).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = minhash.drop_near_duplicates(d, shingle=shingle).collect()
    groups = {c for i, n, c in want if n} | set()
    wordless = [r for r in rows if not (r[1] or "").strip()]
    # one row per component with words (components of different texts may share their smallest id), all rows without
    assert len(kept) >= len(groups) + len(wordless)
    assert {r.doc_id for r in kept if (r.text or "").strip()} == groups


def test_near_duplicates_of_a_large_group(spark):
    """Chains, and a group whose members are not all linked with its smallest: no link is lost."""
    rnd = random.Random(3)
    base = [f"t{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 250):
        w = list(base)
        for _ in range(rnd.randint(1, 5)):
            w[rnd.randrange(60)] = f"n{rnd.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shingle=2)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(near_duplicates(rows, 2))


def test_rows_without_an_id_and_of_one_id(spark):
    """Near copies on rows of a null id and of one id: rows meet the set of their own text only, and a group's
    bytes; results are those of brute force."""
    rnd = random.Random(9)
    base = [f"t{i}" for i in range(80)]

    def near(k):
        w = list(base)
        for _ in range(k % 4):
            w[rnd.randrange(80)] = f"n{rnd.randrange(30)}"
        return " ".join(w)

    rows = [(None, near(k)) for k in range(150)] + [(7, near(k)) for k in range(150)] + [(k, near(k)) for k in range(20, 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(d, shingle=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(near_duplicates(rows, 2), key=str)
    cut = suffix.remove_repeats(d, group_bytes=4000).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in cut), key=str) \
        == sorted(((*r[:4], sha(r[4])) for r in remove_repeats(rows)), key=str)


def test_near_duplicates_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", "x", "sig"), (2, "A b c d e f", None, "y"), (3, None, "x", "z")]
    d = spark.createDataFrame(rows, "id long, text string, cls string, rep string")
    got = minhash.drop_near_duplicates(d, id_col="id")
    assert got.columns == d.columns and sorted(r.id for r in got.collect()) == [1, 3]
    none = minhash.near_duplicates(d.limit(0), id_col="id")
    assert none.count() == 0 and none.columns == ["id", "n_shingles", "component_id", "kept"]


@pytest.mark.parametrize("group_bytes", [suffix.GROUP_BYTES, 100_000])
def test_repeats(spark, group_bytes):
    d = some_docs(spark).where("doc_id is null or doc_id not in (9001, 9002)").union(spark.createDataFrame(
        [(9100, "é" * 40 + "tail"), (9101, "z" + "é" * 40), (9102, "a" * 300), (9103, "a" * 120), (9104, "b" * 49), (9105, "b" * 49)],
        "doc_id long, text string"))
    want = remove_repeats([tuple(r) for r in d.collect()])
    got = suffix.remove_repeats(d.repartition(3), group_bytes=group_bytes, with_text=True).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) \
        == sorted(((*r[:4], sha(r[4])) for r in want), key=str)
    texts = {sha(r[4]): r[4].decode("utf-8", "ignore") for r in want}
    assert all(r.kept_text is None or r.kept_text == texts[r.kept_sha256] for r in got)
    assert sum(r.kept_text is None for r in got) == 2


def test_repeats_of_long_texts_and_other_lengths(spark, monkeypatch):
    """Blocks inside a document, records that differ at their edges, odd lengths; a planted passage."""
    monkeypatch.setattr(suffix, "BLOCK", 700)
    rnd = random.Random(5)
    text = "".join(rnd.choice("abc ") for _ in range(4000))
    rows = [(i, text[rnd.randrange(3000):][:rnd.randrange(900)] + rnd.choice(["", "q"]) + text[:rnd.randrange(200)]) for i in range(40)]
    rows.append((100, text))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (50, 17):
        got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256)
               for r in suffix.remove_repeats(d, length=length, group_bytes=3000).collect()}
        assert got == {r[0]: (r[2], r[3], sha(r[4])) for r in remove_repeats(rows, length)}


@pytest.mark.parametrize("hot", [0, 20])
def test_repeats_of_hot_anchors(spark, hot):
    """A passage with differing neighbours and a phrase of 30 bytes in every document: anchors that are dealt
    out by their strings give what the others give."""
    rnd = random.Random(6)
    def noise(n):
        return "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, phrase = noise(130), noise(30)
    rows = [(i, noise(40) + passage + noise(60) + phrase + noise(40) + (passage[:60] if i % 3 else "")) for i in range(60)]
    rows += [(7, rows[5][1]), (None, rows[9][1]), (None, passage), (-1, phrase), (-2, None), (80, "é" * 70), (81, "é" * 70)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (50, 17):
        got = suffix.remove_repeats(d, length=length, group_bytes=2000, hot=hot).collect()
        want = remove_repeats(rows, length)
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) \
            == sorted(((*r[:4], sha(r[4])) for r in want), key=str)


def test_strings_of_a_hot_anchor_are_dealt_out():
    """Records of one anchor, a phrase between differing neighbours, make strings of many buckets; equal
    strings are sent once, with the smallest id."""
    import numpy as np
    rnd = np.random.RandomState(2)
    data = np.concatenate([np.concatenate([x, np.full(30, 65), x[::-1]]) for x in rnd.randint(97, 123, (200, 40))] * 2).astype(np.uint8)
    low = np.arange(400) * 110 + 30
    starts, number, one, two, least = suffix._strings(data, low, low + 9, np.arange(400) + 5, 50)
    assert len(starts) == 4000 and len(one) == len(two) == 2000 and len(np.unique(one >> np.uint64(58))) == 64
    texts = [data[p:p + 50].tobytes() for p in starts.tolist()]
    assert len(set(zip(texts, number.tolist()))) == 2000 and least[number].tolist() == [5 + (p // 110) % 200 for p in starts.tolist()]


def test_repeats_keep_columns_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "x" * 60, "a", 7), (2, "x" * 60, None, None)], "doc_id long, text string, id string, grp int")
    got = {r.doc_id: r for r in suffix.remove_repeats(d, with_text=True).collect()}
    assert got[2].kept_text == "" and got[1].row.grp == 7 and got[1].row.id == "a"
    assert suffix.remove_repeats(d.limit(0)).count() == 0


@pytest.mark.parametrize("block", [embed.BLOCK, 7])
def test_embeddings(spark, block):
    nan = float("nan")
    d = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label")
    first = [float(x) for x in d.first().embedding]
    near = [[x + (0.02 * k if i < 3 else 0.0) for i, x in enumerate(first)] for k in range(12)]
    d = d.union(spark.createDataFrame(
        [(9001, [1.0, 2.0], 1), (9002, [1.0, 2.0], 1), (9002, [1.0, 2.1], 1), (9003, None, 1), (9004, [0.0, 0.0], 1),
         (9005, [nan, 1.0], 1), (9006, [1.0, None], 1), (9007, [1.0, 2.0], None), (9008, [], 2), (9009, [2.0, 4.0], 1),
         (9010, [-1.0, 0.5], 2), (9011, [float("inf"), 1.0], 2), *[(9100 + k, v, 3) for k, v in enumerate(near)]],
        "vec_id long, embedding array<float>, label int"))
    want = sorted(embedding_links([tuple(r) for r in d.collect()]))
    got = embed.embedding_duplicates(d, block=block).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embed.embedding_duplicates(d.limit(0)).count() == 0


def test_quantisation_bound():
    """The bound holds for every pair, also for vectors of one large and many small components."""
    import numpy as np
    rnd = np.random.RandomState(1)
    v = np.concatenate([rnd.normal(size=(200, 48)), np.eye(48)[:20] + rnd.normal(size=(20, 48)) * 1e-3, rnd.normal(size=(50, 48)) ** 5])
    u = v / np.linalg.norm(v, axis=1)[:, None]
    q, scale, err, back = embed.quantise(u)
    low = (q @ q.T) * scale[:, None] * scale
    assert (np.abs(u @ u.T - low) <= err[:, None] * back + err).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
