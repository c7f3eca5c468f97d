"""Quality rules, licenses, URLs, BPE, importance resampling, HTML."""

import math
import random
import statistics
import re
import time

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import base_counts, license_matches, scan, sha

from pyspark.sql import functions as F

from twinstage.llm import bpe, html, importance, licenses, quality, urls

SMALL = "/root/testdata/sf0.001"


def docs(spark, *extra):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    long_text = "the of " * 50_000
    more = [(-1, None, "en"), (-2, "", None), (-3, " \n ", "xx"), (-4, long_text, "en"), (-5, "a b", "de"), (-5, "a b", "de"), (None, "x", "fr")]
    return d.union(spark.createDataFrame([*more, *extra], "doc_id long, text string, lang string"))


def test_quality_counts(spark):
    rep = " ".join("abcdefgh"), " ".join("abcdefghabcdefgh"), "\n".join(["same line", "same line", "", " ", "other", "same line "])
    d = docs(spark, *[(9000 + k, t, "en") for k, t in enumerate(rep)])
    got = quality.judge_quality(d).collect()
    texts = {}
    for r in d.collect():
        texts.setdefault(r.doc_id, r.text)
    assert len(got) == d.count()
    for r in got:
        want = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_against_labels(spark):
    """Clean documents pass, junk mostly does not."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    j = quality.judge_quality(d).join(good, "doc_id").toPandas()
    sound = j[~j.base_failed]
    assert sound[sound.quality == 1].kept.mean() > 0.99
    assert j[j.quality == 0].kept.mean() < 0.35
    assert d.columns == quality.keep_good(d).columns


def _english(rnd, n):
    common = quality.COMMON_WORDS["en"]
    return " ".join(rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefghiklmnoprst") for _ in range(rnd.randint(3, 9)))
                    for _ in range(n)) + "."


def test_quality_reference_holds_against_skew(spark):
    """Neither one long table nor a hot source of tables turns the verdict on clean texts; texts without a
    language are not held against each other; clean texts just above the guards are not dropped for noise."""
    rnd = random.Random(3)
    def table(n):
        return " ".join(str(rnd.randrange(10**6)) for _ in range(n))
    clean = [(k, _english(rnd, rnd.choice([85, 100, 300])), "en", f"s{k % 5}") for k in range(200)]
    long_one = [(1000, table(60_000), "en", "s0")]
    hot = [(2000 + k, table(200), "en", "hot") for k in range(150)]
    null = [(3000 + k, _english(rnd, 120), None, "s1") for k in range(40)]
    null += [(3100 + k, "".join(rnd.choice("абвгдеж ") for _ in range(900)), None, "s2") for k in range(10)]
    for odd in (long_one, hot):
        d = spark.createDataFrame([*clean, *odd, *null], "doc_id long, text string, lang string, source string")
        got = {r.doc_id: r for r in quality.judge_quality(d).collect()}
        assert [k for k, *_ in clean + null if not got[k].kept] == []
        assert not any(got[k].kept for k, *_ in odd)
        if odd is long_one:
            bare = {r.doc_id: r.kept for r in quality.judge_quality(d.drop("source")).collect()}
            assert all(bare[k] for k, *_ in clean + null) and not bare[1000]


def test_medians_are_exact(spark, monkeypatch):
    """Ties on most cells, one language of most cells, columns without values; also with a coarse sketch."""
    rnd = random.Random(8)
    rows = [("a" if k % 10 else f"l{k % 7}", 0.0 if rnd.random() < 0.7 else rnd.random(), rnd.random(), None if k % 10 else 1.5) for k in range(3001)]
    d = spark.createDataFrame(rows, "lang string, x double, y double, z double").repartition(3)
    for accuracy in (10_000, 40):
        monkeypatch.setattr(quality, "_ACCURACY", accuracy)
        got = {r.lang: r for r in quality._medians(d, ["x", "y", "z"]).collect()}
        for lang in {r[0] for r in rows}:
            for i, c in enumerate("xyz", 1):
                v = [r[i] for r in rows if r[0] == lang and r[i] is not None]
                assert got[lang][c] == (statistics.median(v) if v else None), (lang, c, accuracy)


def test_js_distance(spark):
    rnd = random.Random(1)
    rows = [([rnd.randrange(9) for _ in range(5)], [rnd.randrange(1, 9) for _ in range(5)]) for _ in range(30)] + [([0] * 5, [1] * 5)]
    d = spark.createDataFrame(rows, "p array<long>, q array<long>")
    got = [r[0] for r in d.select(quality.js_distance(d.p, d.q)).collect()]
    for (p, q), g in zip(rows, got):
        if not sum(p):
            assert g is None
            continue
        p, q = np.array(p) / sum(p), np.array(q) / sum(q)
        m = (p + q) / 2
        kl = [sum(a * math.log2(a / c) for a, c in zip(x, m) if a > 0) for x in (p, q)]
        assert abs(g - math.sqrt(max(sum(kl) / 2, 0))) < 1e-6


def test_licenses(spark):
    extra = [(9001, "MIT license apache license. CC-BY-SA 4.0 cc by x; SPDX-License-Identifier: Apache-2.0", "en"),
             (9002, "Licensed under the GNU Lesser General Public License v2.1 mit  MIT  License", "en"),
             (9003, "GNU\ngeneral-public LICENSE gnu general public licensed", "en"),
             (9004, "Released under the MIT License. " * 300, "en"), (9005, "straße cc by ÉCOLE gnu", "fr")]
    d = docs(spark, *extra)
    texts = {}
    for r in d.collect():
        texts.setdefault(r.doc_id, r.text)
    got = licenses.scan_licenses(d).collect()
    assert len(got) == d.count() and len(licenses.signature_rules()) >= 200
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == scan(texts[r.doc_id], licenses.PHRASES), r.doc_id
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        kept = [(m.start, m.end) for m in r.found]
        assert all(0 <= s < e for s, e in kept)
    by = {r.doc_id: r for r in got}
    assert by[9001].labels == "apache,cc-by,cc-by-sa,mit" and by[9001].score == 0.99
    assert by[9002].labels == "lgpl,mit" and len(by[9004].found) == 300


def _samples(parsed):
    """A shortest and a longest text (repeats up to 2) of a parsed regex without look-arounds' content."""
    out = [""] * 2
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            add = [chr(arg)] * 2
        elif op == "IN":
            add = ["s" if str(arg[0][0]) == "CATEGORY" else chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])] * 2
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            inner = _samples(arg[2])
            add = [inner[0] * arg[0], inner[1] * min(arg[1], 2)]
        elif op == "SUBPATTERN":
            add = _samples(arg[3])
        elif op == "BRANCH":
            add = [_samples(arg[1][0])[0], _samples(arg[1][-1])[1]]
        else:
            assert op == "ASSERT_NOT", op
            add = ["", ""]
        out = [a + b for a, b in zip(out, add)]
    return out


def test_license_keywords_are_in_every_match():
    rules = licenses.signature_rules()
    words = "|".join(sorted({r[0] for r in rules}, key=len, reverse=True))
    for keyword, label, _, _, rx in rules:
        for text in _samples(re._parser.parse(rx)):
            assert re.fullmatch(rx, text), (rx, text)
            assert keyword in re.findall(rf"(?<![^ ])(?:{words})(?= |$|v?[0-9])", text), (rx, text)


def test_license_names_without_the_family_keyword(spark):
    texts = {1: ("Common Development and Distribution License 1.0", "cddl"), 2: ("licensed under ASL 2.0", "apache"),
             3: ("General Public License version 3", "gpl"), 4: ("Internet Systems Consortium License", "isc"), 5: ("GPLv3", "gpl"),
             6: ("LGPLv2.1+", "lgpl"), 7: ("under AGPLv3.", "agpl"), 8: ("GPL2", "gpl"), 9: ("gplx gplv gplv9", ""), 10: ("general public", "")}
    d = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(d).collect()}
    assert {k: got[k].labels for k in texts} == {k: v for k, (_, v) in texts.items()}
    assert all((got[k].score > 0) == bool(v) for k, (_, v) in texts.items())


def test_license_suppression(spark):
    rules = [("aa", "inner", 1, 0.5, "bb"), ("aa", "outer", 1, 0.6, "aa bb cc"), ("aa", "worse", 2, 0.4, "aa bb cc dd"),
             ("aa", "twin", 1, 0.7, "aa bb cc"), ("aa", "crossing", 2, 0.3, "cc dd ee")]
    d = spark.createDataFrame([(1, "aa bb cc dd ee"), (2, "bb")], "doc_id long, text string")
    got = {r.doc_id: [m.label for m in r.found] for r in licenses.scan_licenses(d, rules=rules).collect()}
    # inner lies in outer, twin equals outer but comes later; the worse tier contains outer and stays; crossing overlaps only
    assert got == {1: ["worse", "outer", "crossing"], 2: []}


def test_license_matches(spark):
    rng = random.Random(4)
    bits = ["licensed under the apache license 2 0", "MIT License", "gnu general public license v3", "GPLv2", "all rights reserved", "and",
            "spdx-license-identifier: BSD 3-clause", "cc by sa 4.0", "released under the terms of the ISC licence", "bsd", "version 2"]
    texts = {k: " ".join(rng.choices(bits, k=rng.randrange(40))) for k in range(60)} | {90: None, 91: "", 92: "apache"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("found", F.lit("other"))
    rules = licenses.signature_rules()
    got = {r.doc_id: [tuple(m) for m in r.found] for r in licenses.scan_licenses(d).collect()}
    assert got == {k: license_matches(t, rules) for k, t in texts.items()}
    assert licenses.scan_licenses(d.limit(0)).collect() == []


def test_license_many_matches(spark):
    line = "licensed under the apache license 2 0 "
    d = spark.createDataFrame([(1, line), (2, line * 20_000)], "doc_id long, text string")
    took = []
    for part in (d.where("doc_id = 1"), d.where("doc_id = 1"), d):  # compiled; one match; all
        begun = time.monotonic()
        got = {r.doc_id: r for r in licenses.scan_licenses(part).collect()}
        took.append(time.monotonic() - begun)
    assert took[2] - took[1] < 30
    assert len(got[2].found) == 20_000 * len(got[1].found)
    one = got[1].found[0]
    assert [(m.start, m.end) for m in got[2].found] == [(one.start + k * len(line), one.end + k * len(line)) for k in range(20_000)]


def test_urls(spark):
    odd = [(-1, None), (-2, "x"), (-3, "http://COM"), (-4, "http://com/?a://b"), (-5, "a://www.Example.com/en/"),
           (-6, "http://www.example.com./en/"), (-7, "x://b.net/es/\n?"), (-7, "x://b.net/es/\n?"), (-8, "http://"), (-9, "://net/es/#x"),
           (-10, "http://xample.com/en/"), (-11, "http://notexample.com/en/1"), (-12, "http://a.example.com:80/en/"), (None, "http://net/fr/")]
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").union(
        spark.createDataFrame(odd, "page_id long, url string"))
    got = urls.judge_urls(pages, urls.rules_frame(spark, urls.RULES)).select("page_id", "host", "path", "rule", "verdict")
    con = duckdb.connect()
    con.register("pages", pages.toPandas().astype({"page_id": "Int64"}))
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls.oracle(urls.RULES)})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    by = {r.page_id: r for r in got.collect()}
    assert by[-5].rule == "www.example.com/en/" and by[-11].rule == "com/" and by[-7].verdict == "block" and by[-3].rule is None


def test_url_rules_at_large(spark):
    """Many rules, repeated rules, a tie, an empty path, prefixes inside a segment; rules that are none."""
    rules = [(f"h{i}.org", f"/p{i}", "block") for i in range(300)] + [("a.org", "/x", "allow"), ("a.org", "/x", "block"),
                                                                     ("b.org", "", "block"), ("org", "/xy", "allow")]
    pages = spark.createDataFrame([(1, "http://h7.org/p77"), (2, "s://www.a.org/xyz"), (3, "s://b.org"), (4, "s://z.org/xyz")],
                                  "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages, urls.rules_frame(spark, rules)).collect()}
    assert got == {1: ("h7.org/p7", "block"), 2: ("a.org/x", "block"), 3: ("b.org", "block"), 4: ("org/xy", "allow")}
    assert urls.judge_urls(pages.limit(0), urls.rules_frame(spark, rules)).count() == 0
    assert urls.judge_urls(pages, urls.rules_frame(spark, []), default="block").where("verdict = 'block'").count() == 4
    with pytest.raises(ValueError):
        urls.judge_urls(pages, urls.rules_frame(spark, [("a", None, "block")]))


def test_url_rules_with_long_paths(spark):
    """Rules and URLs on both sides of the looked-up length, rules that agree in it, many shapes."""
    rng = random.Random(5)
    k = urls.KEY_PATH
    base = "/" + "ab" * k
    rules = [("x.org", base[:m] + tail, rng.choice(["allow", "block"])) for m in (k - 2, k - 1, k, k + 1, 2 * k - 1)
             for tail in ("", "c", "cc", "d")] + [(f"h{i}." * (i % 9) + "y.org", "/" + "q" * i, "block") for i in range(1500)]
    hosts = ["x.org", "a.x.org", "ax.org", "y.org", *rng.sample([h for h, _, _ in rules], 20)]
    table = [(i, f"s://{rng.choice(hosts)}{rng.choice([base[:m] + t, '/' + 'q' * rng.randrange(1600)])}")
             for i, (m, t) in enumerate((m, t) for m in (1, k - 1, k, k + 1, 2 * k - 1, 2 * k) for t in ("", "c", "cce", "d", "/z") for _ in range(4))]
    table += [(1000 + i, f"http://a.x.org{p}more") for i, (h, p, _) in enumerate(rules) if h == "x.org"]
    pages = spark.createDataFrame(table, "page_id long, url string").withColumn("rule", F.lit("other"))
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages, urls.rules_frame(spark, rules)).collect()}
    assert len(got) == len(table)
    for i, url in table:
        host, path = re.match(r"[^:]*://([^/]*)(.*)", url).groups()
        fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == ((max(fits)[3], max(fits)[2]) if fits else (None, "allow")), (host, len(path))
    assert sum(v[0] is not None and len(v[0]) > len("x.org") + k for v in got.values()) >= 10  # rules longer than what is looked up


@pytest.fixture(scope="module")
def codec():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    truth = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Codec(ranks, public_tokenizers.PATTERN), truth


def test_bpe_strings(codec):
    own, truth = codec
    rnd = random.Random(1)
    texts = ["", " ", "\n\n  x", "a" * 5000, " " * 3000 + "x", "aab" * 200, "don't I'LL we've", "\x1c\x1d a\x85b\u2028c", "<|endoftext|>"]
    texts += ["".join(rnd.choice("ab ABC\n\t'sthe étion12 \u3000\U0001F600") for _ in range(rnd.randint(0, 400))) for _ in range(300)]
    for t, ids in zip(texts, own.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == truth.encode_ordinary(t)
    assert own.decode_all(own.encode_all(texts)) == [t.encode() for t in texts]


def test_bpe_every_code_point(codec):
    own, truth = codec
    for k in range(0, 0x110000, 1 << 14):
        t = "".join(f"a{chr(i)} {chr(i)}b" for i in range(k, k + (1 << 14)) if not 0xD800 <= i < 0xE000)
        assert np.frombuffer(own.encode(t), "<u4").tolist() == truth.encode_ordinary(t), hex(k)


def test_bpe_small_memory(codec):
    """A memory that is always too small changes nothing."""
    own, truth = codec
    tiny = bpe.Codec(own.ranks, public_tokenizers.PATTERN, cache=5)
    texts = ["one two three four five six seven", "two three", "q" * 400 + " eight nine"] * 2
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in tiny.encode_all([t])] == [truth.encode_ordinary(t) for t in texts]


def test_bpe_query(spark, codec):
    d = docs(spark)
    got = bpe.encode_texts(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)
    texts = {}
    for r in d.collect():
        texts.setdefault(r.doc_id, r.text or "")
    rows = got.collect()
    assert len(rows) == d.count()
    for r in rows:
        ids = codec[1].encode_ordinary(texts[r.doc_id])
        assert r.input_ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == sha(np.array(ids, "<u4").tobytes())
        assert r.decoded_sha256 == sha(texts[r.doc_id].encode())
    back = bpe.decode_ids(got, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert all(bytes(r.decoded).decode() == texts[r.doc_id] for r in back)


def test_importance_held_out(spark):
    """The target model is fitted on some labelled documents; others tell good from bad."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit = good.where("doc_id % 3 <> 0 and quality = 1 and toxic = 0").select("doc_id")
    got = importance.importance_sample(d, fit)
    j = got.join(good.where("doc_id % 3 = 0"), "doc_id").toPandas()
    rank, n = j.log_weight.rank(), j.quality.sum()
    auc = (rank[j.quality == 1].sum() - n * (n + 1) / 2) / (n * (len(j) - n))
    assert auc > 0.9
    clean = j[(j.quality == 1) & (j.toxic == 0)]
    assert clean.kept.mean() > 0.95 and j[j.quality == 0].kept.mean() < 0.4
    assert got.where("kept").count() == round(0.85 * d.count())
    again = importance.importance_sample(d.repartition(7), fit).toPandas().sort_values("doc_id")
    assert again.equals(got.toPandas().sort_values("doc_id").set_axis(again.index)) or \
        (again.kept.values == got.toPandas().sort_values("doc_id").kept.values).all()


def test_importance_edges(spark):
    d = docs(spark).select("doc_id", "text")
    some = d.where("doc_id between 1 and 50").select("doc_id")
    got = importance.importance_sample(d, some, fraction=0.5).toPandas()
    assert len(got) == d.count() and not got[got.doc_id.isin([-1, -2, -3]) & got.kept].shape[0]
    cut = got[got.kept].gumbel_key.min()
    assert (got[~got.kept].gumbel_key <= cut).all() and abs(got.kept.sum() - round(0.5 * len(got))) <= 1
    uniform = importance.importance_sample(d, d.limit(0).select("doc_id"), fraction=0.5).toPandas()
    assert (uniform[uniform.n_ngrams > 0].log_weight == 0).all()
    assert importance.importance_sample(d.limit(0), some).count() == 0


def test_kth_largest(spark):
    rnd = random.Random(2)
    v = [rnd.randrange(-2**62, 2**62) for _ in range(500)] + [7] * 300 + [-2**63, 2**63 - 1]
    d = spark.createDataFrame([(x,) for x in v], "k long")
    for k in (1, 2, 250, 400, 600, len(v)):
        value, above = importance.kth_largest(d, d.k, k, bins=16)
        assert value == sorted(v, reverse=True)[k - 1] and above == sum(x > value for x in v)


def test_gumbel_follows_weights(spark):
    """Among equal noise draws over many ids the odds of being chosen follow the weights."""
    u = spark.range(40_000).selectExpr("id", "id % 2 AS heavy")
    key = importance.F.log(-importance.F.log((importance.F.pmod(importance.F.xxhash64(importance.F.lit(1), "id"), importance.F.lit(1 << 52)) + 0.5) / float(1 << 52)))
    k = u.withColumn("key", importance.F.when(u.heavy == 1, math.log(3.0)).otherwise(0.0) - key).orderBy(importance.F.desc("key")).limit(400)
    assert 0.70 < k.where("heavy = 1").count() / 400 < 0.80


CASES = [
    ("<p>one<p>two", "one\n\ntwo"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"), ("<ul><li>x<li><p>y</ul>", "- x\n\n- y"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("x <b>y</b>z", "x yz"),
    ("<table><tr><th>Name<th>N<tr><td>ab<td>1<tr><td>c<td>22</table>", "Name  N\nab    1\nc     22"),
    ("<table><tr><td colspan=2>wide cell<tr><td>a<td>b</table>", "wide cell\na  b"),
    ("<pre>  x\n    y</pre>z", "  x\n    y\n\nz"), ("<script>a<b</script>t<style>p{}</style><!-- c -->u", "tu"),
    ("<style>.h{display:none} #i,p.v{visibility:hidden}</style>a<i class='q h'>b</i><i id=i>c<u style='visibility:visible'>d</u></i>", "ad"),
    ("<p hidden>x</p><p style='display: NONE'>y</p>z", "z"), ("<details><summary>s</summary>t</details>", "s"),
    ("<details open><summary>s</summary>t</details>", "s\nt"), ("&lt;b&gt; &amp;&eacute;", "<b> &é"), ("a < b", "a < b"),
    ("<p>x<!-- open", "x"), ("<title>T</title><h1>H</h1>t", "H\n\nt"), ("<head><meta><p>x</p>", "x"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"), ("<blockquote>q</blockquote>r", "  q\n\nr"), ("", ""), (None, ""),
    ("<select><option>a<option>b</select>", "a\nb"), ("<textarea> a\n b</textarea>", " a\n b"), ("</p>x</div>", "x"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_html(page, text):
    assert html.render(page) == text


_H = "{.h{display:none}}</style>a<i class=h>b</i>"


@pytest.mark.parametrize("page,text", [
    ("<style>@media print " + _H, "ab"), ("<style>@media (max-width:600px) " + _H, "ab"), ("<style>@media screen " + _H, "a"),
    ("<style>@media print, screen and (min-width: 40em) " + _H, "a"), ("<style>@media not print " + _H, "a"),
    ("<style>@media not all and (foo: 1) " + _H, "ab"), ("<style>@media (width <= 600px) " + _H, "ab"), ("<style>@supports (display: grid) " + _H, "a"),
    ("<style>@supports not (display: grid) " + _H, "ab"), ("<style>@layer x " + _H, "a"), ("<style>@keyframes k " + _H, "ab"),
    ("<style>@layer x{@media print" + _H.replace("}}", "}} i{color:red}}"), "ab"), ("<style>@media print{u{x:y}} .h{display:none}</style>a<i class=h>b</i>", "a"),
    ("<style>@charset 'x'; .h{content:'}';display:none}</style>a<i class=h>b</i>", "a"), ("<style>.h{color:red;u{display:none}}</style>a<i class=h>b</i><u>c</u>", "abc"),
    ("<style>.h{@media print{display:none}}</style>a<i class=h>b</i>", "ab"), ("<style>.h{@media screen{display:none}}</style>a<i class=h>b</i>", "a"),
    ("<style media=print>.h{display:none}</style>a<i class=h>b</i>", "ab"), ("<style>.h{display:none", "")])
def test_html_at_rules(page, text):
    assert html.render(page) == text


@pytest.mark.parametrize("page,text", [
    ("<p><svg class='icon'/>after</p><p>next", "after\n\nnext"), ("<p>x <math/>y</p>z", "x y\n\nz"), ("<svg><path d='M0'/><g/></svg>after", "after"),
    ("a<svg><title/><style/><text>b</text></svg>c", "a b c"), ("<p>E <math><mi>E</mi><mo>=</mo><mn>2</mn></math>.", "E E=2."),
    ("<math><semantics><mi>x</mi><annotation>tex</annotation></semantics></math>", "x"),
    ("<svg><title>T</title><desc>D</desc><defs><text>no</text></defs><metadata>M</metadata><g>g<text>a<tspan>b</tspan></text><text>c</text></g></svg>d", "ab c d"),
    ("<svg><foreignObject><p>in</p></foreignObject></svg>out", "in\n\nout"), ("<svg><g><p>x</p>y", "x\n\ny"), ("<svg><g display=none><text>n</text></g><text visibility=hidden>v</text></svg>w", "w"),
    ("<a href=x/>b</a><div/>c</div>d", "b\nc\nd"), ("<svg><a href=x/><text>t</text></a></svg>", "t"), ("<table><tr><td><svg/>x<td>y</table>", "x  y"),
    ("<svg/>" * 400 + "z", "z")])
def test_html_svg_and_math(page, text):
    assert html.render(page) == text


def test_html_list_numbers_do_not_outlive_their_page():
    """Pages one after the other, whose nodes may lie where those of the page before lay."""
    for k in range(3000):
        n, start = k % 7 + 1, k % 11
        page = "<div>" * (k % 5) + f"<ol start={start}>" + "".join(f"<li>x{i}" for i in range(n)) + "</ol>"
        assert html.render(page) == "\n".join(f"{start + i}. x{i}" for i in range(n)), k
    assert html.render("<ol><li>a<ol start=5><li>b</ol><li>c</ol>") == "1. a\n   5. b\n2. c"


def test_html_deep_and_broken():
    deep = "<div>" * 20_000 + "in" + "<table><tr><td>" * 3000 + "side" + "</div>" * 5
    assert html.render(deep).split() == ["in", "side"]
    rnd = random.Random(4)
    parts = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "x y ", "<b", ">", "&", "<!--", "-->", "<a href='", "</", "<br/>",
             "<select>", "<option>", "<pre>", "\n", "<script>", "</script>", "<p hidden>", "<ol start=zz>"]
    for _ in range(400):
        html.render("".join(rnd.choice(parts) for _ in range(60)))


def test_html_query(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html").union(
        spark.createDataFrame([(-1, None), (-2, ""), (None, "<p>x")], "page_id long, html string"))
    got = {r.page_id: r for r in html.extract_text(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        assert got[r.page_id].text == html.render(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


@pytest.mark.parametrize("page, text", [
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td>x<td rowspan=0 colspan=2>y<tr><td>z<td>w</table>", "x  y\nz      w"),
    ("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>", "a  b\nc  d"),
    ("<table><tr><td>\u65e5\u672c<td>b<tr><td>abc<td>d</table>", "\u65e5\u672c  b\nabc   d"),
    ("<style>.a.b{display:none}</style><p class=a>x<p class='b a'>y<p class=b>z", "x\n\nz"),
    ("<style>div .h{display:none}</style><p class=h>x</p><div><p><b class=h>y</b>w</div>", "x\n\nw"),
    ("<style>div > .h{display:none}</style><div><b class=h>x</b><i><b class=h>y</b></i></div>", "y"),
    ("<style>ul > li p > b{display:none}</style><ul><li><div><p><b>x</b>y</p></div></ul><p><b>z</b>", "- y\n\nz"),
    ("<style>.h{display:none!important} p.h{display:block}</style><p class=h>x<p>y", "y"),
    ("<style>#i{display:none} p{display:block}</style><p id=i>x<p>y", "y"),
    ("<style>.h{display:none!important}</style><p class=h style='display:block'>x<p class=h style='display:block !important'>y", "y"),
    ("<style>.h{display:none} .h{display:block}</style><p class=h>x", "x"),
    ("<style>p:hover{display:none} a > > p{display:none} > p{display:none}</style><p>x", "x"),
])
def test_html_tables_and_selectors(page, text):
    assert html.render(page) == text


def test_html_tags_are_those_of_a_plain_scan():
    """Against one regex that starts anew at each place."""
    token = re.compile(r"<!--(?:.*?)(?:-->|\Z)|<([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</([A-Za-z][^\s/>]*+)[^>]*>|<[!?/][^>]*>", re.S)
    rng = random.Random(6)
    for _ in range(20_000):
        page = "".join(rng.choices(["<", ">", '"', "'", "a", "B", "/", " ", "=", "!--", "-->", "?", "<a ", "</b", "\n"], k=rng.randrange(30)))
        want = [(m.start(), m.end(), (m[1] or "").lower(), m[2] or "", (m[3] or "").lower()) for m in token.finditer(page)]
        tags, got, at = html.Tags(page), [], 0
        while m := tags.next(at):
            got.append(m)
            at = m[1]
        assert got == want, page


@pytest.mark.parametrize("page", [
    '<a "' * 500_000, "<a <b" * 400_000, "</a" * 500_000 + ">", "<a<" * 500_000 + '"', "<!" * 900_000, "<a '\" " * 300_000,
    "<title>" + "</title " * 200_000, "<a " + "=" * 1_000_000 + "/>", "<p>x" * 300_000,
    "<style>" + "".join(f".c{k}{{display:none}}" for k in range(40_000)) + "</style>" + "".join(f"<p class=c{2 * k}>x" for k in range(40_000)),
    "<style>" + ".c{display:none}" * 40_000 + "</style>" + "<p class=c>x" * 40_000,
    "<table>" + "<tr><td>" + "x" * 400_000 + "<td>y" + "<tr><td>a<td>b" * 20_000 + "</table>",
    "<table><tr>" + "<td rowspan=0>x" * 20_000 + "<tr><td>y" * 2_000 + "</table>"], ids=range(13))
def test_html_large_pages(page):
    begun = time.monotonic()
    out = html.render(page)
    assert time.monotonic() - begun < 30 and len(out) < 20 * len(page)
