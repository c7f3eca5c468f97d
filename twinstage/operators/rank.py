"""Scalable exact ranking and selection.

``row_number() over (order by …)`` runs in one task, and ``partition by class``
puts the biggest class in one task. These operators replace it:

* ``hashed_rank`` — exact rank by (lead, hash of the id) within a partition. Rows
  are bucketed by the leading bits of the hash, as many bits as *their own class*
  needs: a class of a thousand rows is one bucket, one of 10^11 rows some 10^5, so
  no window partition outgrows ``rows_per_bucket`` and small classes are not split.
  A running sum over the table of bucket sizes gives each bucket's offset.

* ``cut_at_quota`` — the same order cut at a rank per class: only the keys of the bucket that holds the
  cut are ranked; every row is told by its own key, none is shuffled.

* ``middle_values`` / ``kth_in_order`` — exact order statistics of a table: a quantile sketch
  gives ends around the wanted rank, then what lies between them is counted or written, and searched there.

* ``kth_smallest`` / ``kth_smallest_many`` — exact order statistics by narrowing an
  open interval around the wanted rank: pivots from the data, one count per interval
  (map-side aggregate), until a pivot *is* the answer. The same rounds at every size,
  for every orderable type; the driver holds the pivots and their counts, never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import epoch_micros, time_literal
from .small import checkpointed, class_sized

NO_BUCKET = 1 << 62             # stands for the bucket of a null id, the last
HASH_BITS = 40                 # leading bits of the md5 used as bucket number
ROWS_PER_BUCKET = 1 << 20      # target rows per (class, bucket) window partition
SKETCHED = 500_000             # rows of a sketch that only has to find ends around a median
COLLECTED = 50_000             # values between such ends that are ranked by the driver; more are ranked as a table
ACCURACY = 10_000              # of quantile sketches: a rank is off by at most rows / ACCURACY


def hash_bucket(h: Column, bits: Column | int) -> Column:
    """Leading ``bits`` of the hex hash as a long; monotone in the hash order."""
    lead = F.conv(F.substring(h, 1, HASH_BITS // 4), 16, 10).cast("long")
    return F.floor(lead / F.pow(F.lit(2.0), F.lit(HASH_BITS) - bits)).cast("long")


def bucket_bits(rows: Column, rows_per_bucket: int = ROWS_PER_BUCKET) -> Column:
    """Bits that cut a class of ``rows`` rows into buckets of about ``rows_per_bucket``."""
    return F.when(rows <= rows_per_bucket, F.lit(0)).otherwise(
        F.least(F.ceil(F.log2(rows / F.lit(float(rows_per_bucket)))), F.lit(HASH_BITS))).cast("int")


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> list[Column]:
    return [left[a].eqNullSafe(right[b]) for a, b in pairs]


def hashed_rank(df: DataFrame, id_col: str, seed, partition: list[str], lead: list[str],
                rows_per_bucket: int = ROWS_PER_BUCKET, rank_col: str = "_rank") -> DataFrame:
    """1-based rank of rows in the order (lead, md5(seed:id), id) within ``partition``.

    ``seed`` is an int or a Column (per-run seeds of repeated CV). Joins are
    null-safe equi-joins with class- and bucket-sized tables, by broadcast if these are small by count.
    """
    seed_txt = F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")
    groups = [*partition, *lead]
    sizes = df.groupBy(*groups).agg(bucket_bits(F.count(F.lit(1)), rows_per_bucket).alias("_bits"))
    sizes = class_sized(sizes.select(*[F.col(c).alias(f"_s_{c}") for c in groups], "_bits"))
    t = df.withColumn("_h", F.md5(F.concat(seed_txt, F.lit(":"), F.col(id_col).cast("string"))))
    on = null_safe(t, sizes, [(c, f"_s_{c}") for c in groups])
    t = (t.join(sizes, on) if on else t.crossJoin(sizes)).drop(*[f"_s_{c}" for c in groups])
    t = t.withColumn("_bucket", hash_bucket(F.col("_h"), F.col("_bits"))).drop("_bits")
    keys = [*groups, "_bucket"]
    counts = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    before = (Window.partitionBy(*partition).orderBy(*[F.col(k).asc_nulls_last() for k in [*lead, "_bucket"]])
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = class_sized(counts.select(*[F.col(k).alias(f"_o_{k}") for k in keys],
                                        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).cast("long").alias("_off")))
    j = t.join(offsets, null_safe(t, offsets, [(k, f"_o_{k}") for k in keys])).drop(*[f"_o_{k}" for k in keys])
    inside = Window.partitionBy(*keys).orderBy("_h", id_col)
    return j.withColumn(rank_col, F.col("_off") + F.row_number().over(inside)).drop("_off", "_bucket", "_h")


def cut_at_quota(df: DataFrame, id_col: str, seed: int, y: str, quotas: DataFrame, out: str) -> DataFrame:
    """``out`` = 1 for the first ``_quota`` rows of each class ``y`` (table ``quotas``: _class, _quota) in the order
    (md5(seed:id), id), the order of ``hashed_rank``, else 0.

    A class of n rows gets some √n buckets of √n rows by the leading bits of the hash. Counts by (class, bucket) tell which
    bucket holds the cut; the rows of that one bucket a class are ranked by a window, (class, hash, id) only, which gives the
    key of the last row inside. Every row is then told by its own key as it is read: none is shuffled. Only where rows of
    the very same key lie on both sides of a cut are these rows, and no others, numbered.
    """
    h = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(id_col).cast("string")))
    bucket = F.coalesce(hash_bucket(F.col("_h"), F.col("_bits")), F.lit(NO_BUCKET))
    sizes = df.groupBy(F.col(y).alias("_s")).agg(F.least(F.ceil(F.log2(F.count(F.lit(1))) / 2), F.lit(HASH_BITS)).cast("int").alias("_bits"))
    sizes = sizes.join(quotas, F.col("_s").eqNullSafe(F.col("_class"))).where("_quota > 0")
    sizes = class_sized(sizes.select("_s", "_bits", "_quota"))
    keys = df.select(F.col(y).alias("_y"), F.col(id_col).alias("_id"), h.alias("_h"))
    keys = keys.join(sizes, F.col("_y").eqNullSafe(F.col("_s"))).withColumn("_bucket", bucket)
    counts = keys.groupBy("_y", "_bits", "_quota", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_y").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.withColumn("_upto", upto).where(F.col("_upto") >= F.col("_quota"))
    at = counts.groupBy(F.col("_y").alias("_c")).agg(F.min_by(F.struct(F.col("_bucket").alias("at"), (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("need")),
                                                              "_bucket").alias("_at"))
    at = class_sized(at)
    held = keys.join(at, F.col("_y").eqNullSafe(F.col("_c"))).where(F.col("_bucket") == F.col("_at.at"))
    inside = Window.partitionBy("_y").orderBy("_h", "_id")
    cut = held.select("_y", "_bits", "_at", "_h", "_id", F.row_number().over(inside).alias("_r"), F.rank().over(inside).alias("_first"),
                      F.count(F.lit(1)).over(Window.partitionBy("_y", "_h", "_id")).alias("_same")).where(F.col("_r") == F.col("_at.need"))
    cut = checkpointed(cut.select(F.col("_y").alias("_c"), F.struct("_bits", F.col("_at.at").alias("at"), F.struct("_h", "_id").alias("key"),
                                                                   (F.col("_r") - F.col("_first") + 1).alias("take"), F.col("_same").alias("same")).alias("_cut")))
    split = cut.where("_cut.take < _cut.same").count()
    cut = class_sized(cut)
    t = df.withColumn("_h", h)
    t = t.join(cut, t[y].eqNullSafe(cut["_c"]), "left").drop("_c")
    b = F.coalesce(hash_bucket(F.col("_h"), F.col("_cut._bits")), F.lit(NO_BUCKET))
    key = F.struct(F.col("_h").alias("_h"), F.col(id_col).alias("_id"))
    is_in = (b < F.col("_cut.at")) | ((b == F.col("_cut.at")) & (key <= F.col("_cut.key")))
    told = F.coalesce(is_in, F.lit(False)).cast("int")
    if not split:
        return t.withColumn(out, told).drop("_h", "_cut")
    tied = F.coalesce((key == F.col("_cut.key")) & (F.col("_cut.take") < F.col("_cut.same")), F.lit(False))
    number = F.row_number().over(Window.partitionBy(y).orderBy("_h", id_col))
    ties = t.where(tied).withColumn(out, (number <= F.col("_cut.take")).cast("int"))
    return t.where(~tied).withColumn(out, told).unionByName(ties).drop("_h", "_cut")


# ---------------------------------------------------------------------------
# exact selection
# ---------------------------------------------------------------------------

def _interval(key: Column, pivots: Column) -> Column:
    """2 × (pivots below the key), plus 1 if the key is a pivot itself."""
    below = F.size(F.filter(pivots, lambda p: p < key))
    return 2 * below + F.array_contains(pivots, key).cast("int")


def kth_smallest(df: DataFrame, key: str, k: int, where: Column | None = None,
                 pivots: int = 128, max_rounds: int = 500):
    """(value, j) of the k-th smallest (0-based) non-null ``key`` among rows matching ``where``;
    ``j`` is the row's position among rows equal to ``value``.

    Any orderable type (text and full-range integers too): keys are only compared, never
    subtracted. Pivots are random rows of the open interval, so each round leaves about
    one ``pivots``-th of it; a frequent value is soon a pivot, and equality ends the search.
    """
    base = (df if where is None else df.where(where)).select(F.col(key).alias("_key")).where(F.col("_key").isNotNull())
    c = F.col("_key")
    n = base.count()
    if k < 0 or k >= n:
        raise ValueError(f"k={k} out of range for {n} rows")
    dtype = base.schema["_key"].dataType
    rng = base
    for round_ in range(max_rounds):
        drawn = rng.orderBy(F.rand(round_)).limit(pivots)
        found = drawn.agg(F.sort_array(F.collect_set("_key")).alias("p")).first()["p"]
        values = F.array(*[F.lit(v).cast(dtype) for v in found])
        hist = rng.groupBy(_interval(c, values).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()  # ≤ 2·pivots+1
        for r in sorted(hist):
            if k < r["n"]:
                b = r["b"]
                break
            k -= r["n"]
        if b % 2:
            return found[b // 2], k
        lo, hi = b // 2 - 1, b // 2
        if lo >= 0:
            rng = rng.where(c > F.lit(found[lo]).cast(dtype))
        if hi < len(found):
            rng = rng.where(c < F.lit(found[hi]).cast(dtype))
    raise RuntimeError("selection did not converge")


def kth_in_order(df: DataFrame, ts: str, id_col: str, k: int, non_null: int, near: tuple = (None, None)):
    """Key (ts, id) of the k-th row (0-based) in the order ts ascending nulls last, then id; ``ts`` a timestamp.

    ``near``: epoch microseconds that a sketch holds the answer's time to lie between (None: open). Rows
    between them are written once, (time, id) only, and searched there; rows on the shorter side of them are
    counted. The two are disjoint ranges of the raw column with literal ends, so both filters are
    pushed into the file reader (which skips no row groups for TIMESTAMP_NTZ and INT96). Should the ends not hold the answer, the search takes all rows.
    """
    c, dtype = F.col(ts), dict(df.dtypes)[ts]
    if k >= non_null:
        ids = checkpointed(df.where(c.isNull()).select(id_col))
        return None, kth_smallest(ids, id_col, k - non_null)[0]
    for lo, hi in (near, (None, None)):
        low, high = time_literal(lo, dtype), time_literal(hi, dtype)
        rows = df.where(c.isNotNull())
        held = rows if low is None else rows.where(c >= low)
        held = held if high is None else held.where(c <= high)
        held = checkpointed(held.select(epoch_micros(ts, dtype).alias("_us"), F.col(id_col)))
        n = held.count()
        if low is not None and (high is None or 2 * k < non_null):
            below = rows.where(c < low).count()
        else:
            below = non_null - n - (0 if high is None else rows.where(c > high).count())
        if below <= k < below + n:
            us, j = kth_smallest(held, "_us", k - below)
            return us, kth_smallest(held, id_col, j, where=F.col("_us") == F.lit(us))[0]
    raise RuntimeError("the table changed between two scans")


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def middle_values(df: DataFrame, cols: list[str], accuracy: int = ACCURACY) -> dict[str, tuple[float, float] | None]:
    """Column → the values at ranks ⌊(n-1)/2⌋ and ⌊n/2⌋ (0-based) of its n finite values; None without any.

    Four scans of ``df`` at most for all columns together, at every size. A quantile sketch over some ``SKETCHED`` rows
    (all, if fewer) gives two values on either side of the middle of each column. One aggregate without a
    shuffle of rows counts, exactly, the values below, at and between the two: most columns end there, their median
    is one of the two. For the others the values strictly between are counted by value (map-side) and the ranks
    found there. A column whose two values do not hold both ranks gets a sketch of all its rows, then no ends at all.
    """
    if not cols:
        return {}
    base = df.select(*[_finite(c).alias(f"v{i}") for i, c in enumerate(cols)])
    out: dict[str, tuple[float, float] | None] = dict.fromkeys(cols)
    rows, inf = df.count(), float("inf")
    part = min(1.0, SKETCHED / rows) if rows else 1.0
    open_ = list(range(len(cols)))
    for share in ([part, 1.0, None] if part < 1 else [1.0, None]):
        if not open_:
            break
        ends = dict.fromkeys(open_, (-inf, inf))
        if share is not None:
            side = min(0.5, 2.0 / accuracy if share == 1 else max(2.0 / accuracy, 2.5 / SKETCHED ** 0.5))  # five deviations of a sampled rank
            seen = base if share == 1 else base.sample(share, 7)
            got = seen.agg(*[F.percentile_approx(f"v{i}", [0.5 - side, 0.5 + side], accuracy).alias(f"q{i}") for i in open_]).first()
            ends = {i: tuple(got[f"q{i}"]) for i in open_ if got[f"q{i}"] is not None}
            if share == 1:
                open_ = list(ends)  # the others have no values
        if not ends:
            continue
        sums = []
        for i, (lo, hi) in ends.items():
            x = F.col(f"v{i}")
            sums += [F.count(x).alias(f"n{i}"), F.count(F.when(x < F.lit(lo), 1)).alias(f"b{i}"),
                     F.count(F.when(x == F.lit(lo), 1)).alias(f"l{i}"), F.count(F.when(x < F.lit(hi), 1)).alias(f"h{i}"),
                     F.count(F.when(x == F.lit(hi), 1)).alias(f"u{i}")]
        c = base.agg(*sums).first()
        inside: dict[int, list[int]] = {}
        for i, (lo, hi) in ends.items():
            n, start, top = c[f"n{i}"], c[f"b{i}"] + c[f"l{i}"], c[f"h{i}"]
            wanted = ((n - 1) // 2, n // 2)
            if not (n and c[f"b{i}"] <= wanted[0] and wanted[1] < top + c[f"u{i}"]):
                continue  # not held, or not one value
            open_.remove(i)
            found = [lo if k < start else hi if k >= top else None for k in wanted]
            out[cols[i]] = tuple(found)
            if None in found:
                inside[i] = [k - start for k in wanted]
        if not inside:
            continue
        held = sum(c[f"h{i}"] - c[f"b{i}"] - c[f"l{i}"] for i in inside)
        entries = [F.when((F.col(f"v{i}") > F.lit(ends[i][0])) & (F.col(f"v{i}") < F.lit(ends[i][1])),
                          F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("v"))) for i in inside]
        counted = base.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.c", "e.v").agg(F.count(F.lit(1)).alias("n"))
        if held <= COLLECTED:  # so few values are ranked on the spot
            lists: dict[int, list] = {}
            for r in sorted((r["c"], r["v"], r["n"]) for r in counted.collect()):
                lists.setdefault(r[0], []).append(r[1:])
            value = {(i, k): _at_rank(lists.get(i, []), k) for i, ks in inside.items() for k in ks}
        else:
            counted = checkpointed(counted)
            kept = {i: c[f"h{i}"] - c[f"b{i}"] - c[f"l{i}"] for i in inside}
            targets = [(i, k) for i, ks in inside.items() for k in ks if 0 <= k < kept[i]]
            wide = counted.select(*[F.when(F.col("c") == i, F.col("v")).alias(f"v{i}") for i in inside], "n")
            value = dict(zip(targets, kth_smallest_many(wide, [(f"v{i}", k) for i, k in targets], weight="n")))
        for i, ks in inside.items():
            out[cols[i]] = tuple(value[i, k] if v is None else v for k, v in zip(ks, out[cols[i]]))
    return out


def _at_rank(counted: list[tuple[float, int]], k: int) -> float | None:
    """The k-th (0-based) of sorted values that come n times each; None outside."""
    if k < 0:
        return None
    for v, n in counted:
        if k < n:
            return v
        k -= n
    return None


def kth_smallest_many(df: DataFrame, targets: list[tuple[str, int]], max_rounds: int = 100,
                      accuracy: int = ACCURACY, weight: str | None = None) -> list[float]:
    """Exact k-th smallest (0-based, as double) for many (column, k) targets at once; NaN and
    infinities count as missing. A row counts ``weight`` times (a column of whole numbers; None: once).

    Every round reads the data twice for all open columns together: approximate quantiles
    around the wanted ranks give pivots (values of the column), then one aggregate counts
    the intervals between them. An interval shrinks by the quantiles' accuracy per round.
    """
    cols = sorted({c for c, _ in targets})

    times = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    base = df.select(*[_finite(c).alias(f"v{i}") for i, c in enumerate(cols)], times.alias("w"))
    counts = base.agg(*[F.coalesce(F.sum(F.when(F.col(f"v{i}").isNotNull(), F.col("w"))), F.lit(0)).alias(f"v{i}")
                        for i in range(len(cols))]).first() if cols else {}
    st = []
    for c, k in targets:
        v = f"v{cols.index(c)}"
        if not 0 <= k < counts[v]:
            raise ValueError(f"k={k} out of range for {counts[v]} values of {c}")
        st.append({"col": v, "k": k, "lo": None, "hi": None, "n": counts[v], "v": None})
    for _ in range(max_rounds):
        open_ = [t for t in st if t["v"] is None]
        if not open_:
            return [t["v"] for t in st]
        ranges: dict[tuple, list[dict]] = {}
        for t in open_:
            ranges.setdefault((t["col"], t["lo"], t["hi"], t["n"]), []).append(t)
        inside = []
        for col, lo, hi, _ in ranges:
            x = F.col(col)
            cond = x.isNotNull()
            if lo is not None:
                cond = cond & (x > F.lit(lo))
            if hi is not None:
                cond = cond & (x < F.lit(hi))
            inside.append(F.when(cond, x))
        probs = []
        for (_, _, _, n), ts in ranges.items():
            # the sketch does not know weights: with these, ends at even steps of the distinct rows
            at = ({(t["k"] + 0.5) / n + s * w for t in ts for s in (-1, 0, 1) for w in (2.0 / accuracy, 0.01, 0.1)}
                  if weight is None else {i / 64 for i in range(65)})
            probs.append(sorted(min(max(p, 0.0), 1.0) for p in at))
        got = base.agg(*[F.percentile_approx(x, p, accuracy).alias(f"q{g}")
                         for g, (x, p) in enumerate(zip(inside, probs))]).first()
        pivots = [sorted(set(q)) for q in got]
        entries = [F.when(x.isNotNull(), F.struct(F.lit(g).alias("g"), _interval(
            x, F.array(*[F.lit(p) for p in ps])).alias("b"))) for g, (x, ps) in enumerate(zip(inside, pivots))]
        hist = (base.select(F.explode(F.array(*entries)).alias("e"), "w").where(F.col("e").isNotNull())
                .groupBy("e.g", "e.b").agg(F.sum("w").alias("n")).collect())  # ≤ intervals of the open ranges
        for g, ts in enumerate(ranges.values()):
            rows = sorted((r["b"], r["n"]) for r in hist if r["g"] == g)
            for t in ts:
                k = t["k"]
                for b, n in rows:
                    if k < n:
                        break
                    k -= n
                ps = pivots[g]
                if b % 2:
                    t["v"] = ps[b // 2]
                else:
                    t.update(k=k, n=n, lo=ps[b // 2 - 1] if b else t["lo"], hi=ps[b // 2] if b // 2 < len(ps) else t["hi"])
    raise RuntimeError("selection did not converge")
