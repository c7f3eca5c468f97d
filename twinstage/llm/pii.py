r"""Personal data: base kinds, and terms that reveal them, by information theory over the corpus.

*Base spans*: emails, IP addresses, card numbers and phone numbers, each kind by itself
(leftmost, not overlapping; matches that fail the kind's test are dropped).

*Disclosing terms*: a text without its emails and numbers may still tell whose they are. The protected
entities are the distinct values of the base kinds. A term is a word of letters, A–Z folded, that
stands alone between white space (punctuation aside). For an entity e and a term t within
``reach`` code points of it (and no further than the next match of its kind), over all N rows,

    information of e    IC(e)     = log2(N / n(e))
    revealed by t       PMI(e, t) = log2(N · n(e, t) / (n(e) · n(t)))
    disclosure          PMI(e, t) / IC(e), 1 if t stands nowhere else,

n(e) rows hold e, n(t) hold t anywhere, n(e, t) hold t near e. Only pairs seen in two
different contexts are judged, so copies of one passage are no evidence. From ``generalise``
on a term near the entity gets a span and is replaced by its class, from ``remove`` on it goes.

Base spans and the contexts are found inside the row; then rows of (entity, term), rows of
(word hash) and a few numbers each are counted, both pre-aggregated where they arise, and the
terms found go back by a row number. A frequent word or entity is one counter a task, a
document is never compared with another. The row numbers are written with the spans
once, so they do not change under a rerun. Time is linear in a text and its matches.

Edge cases: a null or empty text has no spans; rows that repeat, and rows with a null or
repeated id, are answered each (and count as rows); an entity in every row (IC 0) is not revealed by
anything; an empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as X

# The base kinds, in their order. Starts are bound to the begin of a run (or to the last match)
# and repeats are possessive, which finds the same matches in linear time and without recursion.
_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SPACE, _MARK = r"[\x20\x09-\x0D]", r"[!-/:-@\[-`{-~]{0,4}"
TERM = rf"(?<=(?:^|{_SPACE}){_MARK})[A-Za-z\x{{80}}-\x{{10FFFF}}]{{3,}}+(?={_MARK}(?:$|{_SPACE}))"
_WORD_BREAK = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CUT = "0"  # stands where a context is cut or meets its entity: what touches it is no term


def _fold(c: Column) -> Column:
    return F.translate(c, _AZ, _AZ.lower())


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """The check sum of a string of digits is a multiple of ten."""
    def weight(d: Column, i: Column) -> Column:
        x = F.substr(d, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = X.let(digits, lambda d: F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + weight(d, i)))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return X.let(_digits(value), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _may_hold(kind: str, text: Column) -> Column:
    """True for every text with a valid match."""
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), "phone": text.contains("+"),
            "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")}[kind]


def _context(c: Column, reach: int, left: bool) -> Column:
    near = F.right(c, F.lit(reach)) if left else F.left(c, F.lit(reach))
    cut = F.when(F.length(c) > reach, F.lit(_CUT)).otherwise(F.lit(""))
    return F.concat(cut, near, F.lit(_CUT)) if left else F.concat(F.lit(_CUT), near, cut)


_ENTITY = "array<struct<kind:string,start:int,end:int,entity:bigint,left:string,right:string>>"


def _entities(text: Column, kind: str, reach: int) -> Column:
    """(kind, start, end, entity, left, right) of the valid matches of a kind."""
    found = F.transform(F.filter(X.matches_of(text, KINDS[kind]), lambda m: _valid(kind, m["value"])), lambda m: F.struct(
        F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
        F.xxhash64(F.lit(kind), _digits(m["value"]) if kind in ("card", "phone") else _fold(m["value"])).alias("entity"),
        _context(m["before"], reach, True).alias("left"), _context(m["after"], reach, False).alias("right")))
    return F.when(_may_hold(kind, text), found).otherwise(F.array().cast(_ENTITY)).cast(_ENTITY)


def _terms(e: Column) -> Column:
    """(start, end, term) of the terms in the two contexts of an entity, by places of the whole text."""
    def side(context: Column, base: Column) -> Column:
        return F.transform(X.matches_of(context, TERM), lambda m: F.struct(
            (base + m["start"]).alias("start"), (base + m["end"]).alias("end"), F.xxhash64(_fold(m["value"])).alias("term"),
            F.ascii(m["value"]).between(65, 90).alias("name")))
    return F.concat(side(e["left"], e["start"] - F.length(e["left"]) + 1), side(e["right"], e["end"] - 1))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 80, generalise: float = 0.75,
                       remove: float = 0.95, with_text: bool = False) -> DataFrame:
    """One row per document: id_col, spans (array of kind, start, end, action; kinds as listed, then ``term``, each by start; action
    mask, generalise or remove) and, if asked for, clean_text: the text with base spans masked by their kind, terms replaced or removed."""
    X.ready(docs.sparkSession)
    text = F.col("text")
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = src.select("row", "id", *(["text"] if with_text else []), F.concat(*[_entities(text, k, reach) for k in KINDS]).alias("base"))
    held = X.stored(found, "pii-base")
    near = held.where(F.size("base") > 0).select("row", F.explode("base").alias("e")) \
        .select("row", F.col("e.entity").alias("entity"), F.xxhash64(_fold(F.col("e.left")), _fold(F.col("e.right"))).alias("context"),
                F.explode_outer(_terms(F.col("e"))).alias("t")).select("row", "entity", "context", "t.*")
    near = X.stored(near, "pii-near")
    words = src.select(F.explode(F.array_distinct(F.transform(F.split(_fold(text), _WORD_BREAK), lambda w: F.xxhash64(w)))).alias("term"))
    n_term = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    n_entity = near.groupBy("entity", "row").agg(F.lit(1).alias("one")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    pairs = near.where("term IS NOT NULL").groupBy("entity", "term", "row").agg(F.min("context").alias("a"), F.max("context").alias("b")) \
        .groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et"), F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b")
    n = F.lit(float(held.count()))
    scored = pairs.join(n_entity, "entity").where(F.col("n_e") < n).join(n_term, "term").withColumn(
        "score", F.log2(n * F.col("n_et") / (F.col("n_e") * F.col("n_t"))) / F.log2(n / F.col("n_e")))
    telling = X.stored(scored.where(F.col("score") >= generalise).select("entity", "term", "score"), "pii-terms")
    hits = near.join(telling, ["entity", "term"]).groupBy("row", "start", "end").agg(F.max("score").alias("score"), F.first("name").alias("name"))
    action = F.when(F.col("score") >= remove, "remove").otherwise("generalise")
    hits = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", action.alias("action"), "name"))).alias("terms"))

    out = held.join(hits, "row", "left")
    spans = F.transform("base", lambda e: F.struct(e["kind"].alias("kind"), e["start"].alias("start"), e["end"].alias("end"),
                                                   F.lit("mask").alias("action")))
    told = F.transform("terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"),
                                                   t["action"].alias("action")))
    cols = [F.col("id").alias(id_col), F.concat(spans, F.coalesce(told, F.array().cast(_SPAN))).cast(_SPAN).alias("spans")]
    if with_text:
        masks = F.transform("base", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"),
                                                       F.concat(F.lit("<"), F.upper(e["kind"]), F.lit(">")).alias("put")))
        classes = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(
            t["action"] == "remove", "").when(t["name"], "<NAME>").otherwise("<WORD>").alias("put")))
        puts = F.concat(masks, F.coalesce(classes, F.array().cast(_PUT))).cast(_PUT)
        cols.append(F.when(F.size("base") > 0, replaced(text, F.array_sort(puts))).otherwise(text).alias("clean_text"))
    return out.select(*cols)


_SPAN = "array<struct<kind:string,start:int,end:int,action:string>>"
_PUT = "array<struct<start:int,end:int,put:string>>"


def replaced(text: Column, puts: Column, block: int = 1024) -> Column:
    """The text with each (start, end, put), sorted by start, replaced; of overlapping ones the first is put and all go.
    Pieces are cut from blocks of the text, as a place in a string is found by counting from its begin."""
    def piece(blocks: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / block).cast("int"), F.floor(b / block).cast("int")
        return F.when(a < b, F.substr(F.array_join(F.slice(blocks, i + 1, j - i + 1), ""), a - i * block + 1, b - a)).otherwise("")

    def body(blocks: Column) -> Column:
        def joined(p: Column) -> Column:
            return X.let(F.zip_with(p, running_end(p), lambda x, e: F.struct(x.alias("x"), e.alias("e"))), lambda z: F.concat(
                F.array_join(F.transform(z, lambda s: F.when(s["x"]["start"] >= s["e"], F.concat(
                    piece(blocks, s["e"], s["x"]["start"]), s["x"]["put"])).otherwise("")), ""),
                piece(blocks, F.array_max(F.transform(z, lambda s: s["x"]["end"])), F.length(text))))
        return X.let(puts, joined)

    def running_end(p: Column) -> Column:
        return X.running(F.transform(p, lambda x: x["end"]), F.greatest)

    return X.let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)), body)
