"""Mixing sources to target weights by Poisson replication.

A source with size c (characters) and target weight w in a mixture of T
characters is to be repeated r = w T / c times on average.  Each document
gets the number of copies at which the Poisson distribution with mean r
passes the document's own uniform number, hashed from its id and the seed;
the documents are exploded by their counts and ordered by a hash of id and
copy, which shuffles the mixture globally and reproducibly.

Rows with a null source form one source.  Rows that share an id share their
uniform number and so their count.  A source without characters has rate 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from sifter.llm.common import boxed, written

_UNIT = float(1 << 52)


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(_UNIT)


def rates(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", temperature: float = 0.5,
          weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, n_docs, size, weight, rate) per source, from a written table, so
    that Spark knows its size and broadcasts it only where that is small.

    Target weights are the given ones, or proportional to size**temperature;
    the mixture has ``epochs`` times the characters of the corpus.  With given
    weights, sources that are not named have weight 0.
    """
    size = F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("long"))
    per = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"), size.alias("size"))
    raw = F.pow(F.col("size").cast("double"), F.lit(float(temperature)))
    if weights is not None:
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when(F.col("source") == name, F.lit(float(w))).otherwise(raw)
    per = per.withColumn("raw", raw)
    per = written(per, "sources")
    total, all_raw = per.agg(F.sum("size"), F.sum(F.col("raw").cast("decimal(38,9)"))).first()
    total, all_raw = float(total or 0), float(all_raw or 0)
    if not total or not all_raw:
        return per.select("source", "n_docs", "size", F.lit(0.0).alias("weight"), F.lit(1.0).alias("rate"))
    weight = F.col("raw") / F.lit(all_raw)
    rate = F.when(F.col("size") > 0, weight * F.lit(float(epochs)) * F.lit(total) / F.col("size")).otherwise(F.lit(1.0))
    return per.select("source", "n_docs", "size", weight.alias("weight"), rate.alias("rate"))


def _most(rate: Column) -> Column:
    """A count that a Poisson variable of this mean passes with a chance far
    below 2**-52, the step of the uniform numbers."""
    return F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")


def poisson_count(rate: Column, u: Column) -> Column:
    """The smallest k with P(X <= k) > u for X Poisson with mean ``rate``;
    rate up to 700, where exp(-rate) is still a double."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"))

    def step(acc, i):
        p = acc["p"] * rate / i
        return F.when(acc["cdf"] > u, acc).otherwise(
            F.struct(i.cast("int").alias("k"), p.alias("p"), (acc["cdf"] + p).alias("cdf")))

    return F.aggregate(F.sequence(F.lit(1), _most(rate)), start, step)["k"]


def counted(docs: DataFrame, seed: int, *, keep: list[str], id_col: str = "doc_id", source_col: str = "source", **rate_args) -> DataFrame:
    """(_row, id, copies): the ``keep`` columns as a struct and the number of
    copies.  Rates above 700 are whole repetitions plus a Poisson rest."""
    per = rates(docs, source_col=source_col, **rate_args).select("source", "rate")
    rows = boxed(docs, keep, id=F.col(id_col), key=F.col(source_col))
    joined = rows.join(per, F.col("key").eqNullSafe(F.col("source")))
    whole = F.floor(F.greatest(F.col("rate") - 700, F.lit(0.0))).cast("int")
    n = (whole + poisson_count(F.col("rate") - whole, uniform(seed, F.col("id")))).cast("int")
    return joined.select("_row", "id", n.alias("copies"))


def mix(docs: DataFrame, seed: int = 13, *, id_col: str = "doc_id", source_col: str = "source", keep: list[str] | None = None,
        **rate_args) -> DataFrame:
    """``keep`` columns (default: all) of every copy of every row, with
    ``copy_no`` (from 1), ``n_copies`` and ``shuffle_key``, in the order of
    that key: the global shuffle.  Columns with these names are replaced."""
    cols = [c for c in (keep or docs.columns) if c not in ("copy_no", "n_copies", "shuffle_key")]
    rows = counted(docs, seed, keep=cols, id_col=id_col, source_col=source_col, **rate_args).where("copies > 0")
    copies = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    key = uniform(seed + 1, F.col("id"), F.col("copy_no"))
    return (copies.select("_row", "copy_no", F.col("copies").alias("n_copies"), key.alias("shuffle_key"))
            .orderBy("shuffle_key").select("_row.*", "copy_no", "n_copies", "shuffle_key"))


def expected_count(rate: float, u: float) -> int:
    """``poisson_count`` for one number, for tests and small tables."""
    k, p = 0, math.exp(-rate)
    cdf = p
    while cdf <= u:
        k += 1
        p *= rate / k
        if p == 0.0:
            break
        cdf += p
    return k
