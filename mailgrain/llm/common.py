"""Shared helpers: table access, written intermediate tables, native span finding and text indexing."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import scratch_dir

#: White space that separates words: space, tab, newline, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor costs a reread, not a recomputation. All that is
    left is removed at the end of the session at the latest (:func:`drop_since` does so earlier)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/mailgrain-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.written = 0
        if not _roots:
            atexit.register(drop_since, spark, 0)
        _roots.append(self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{self.written}"
        self.written += 1
        df.write.parquet(path, compression="zstd")
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove the last table of this name, which nothing lazy may read any more."""
        remove(self.spark, self.paths[name])


_roots: list[str] = []  # of this process's scratch folders, in order


def scratch_mark() -> int:
    return len(_roots)


def drop_since(spark: SparkSession, mark: int) -> None:
    """Remove all scratch folders made since a mark, once what was built on them has been written."""
    for root in _roots[mark:]:
        remove(spark, root)
    del _roots[mark:]


def remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone; what stays is only space
        pass


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` if a count shows that it has ``max_rows`` rows at most; else leave the join to shuffling and
    adaptive skew handling. The count stops one row beyond the bound."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(lengths: Column) -> Column:
    """Running sums before each element of an array<int>; see :func:`before_each`."""
    return before_each(lengths, lambda a, x: a + x)


def before_each(values: Column, add) -> Column:
    """What ``add`` makes of 0 and all elements before each of an array<int>: sums, or maxima. In blocks of 128, so that long
    arrays stay cheap."""
    block = 128

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), add)

    def blocks(a: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")),
            lambda b: total(F.slice(a, b * block + 1, F.lit(block))),
        )

    def starts(sums: Column) -> Column:
        return F.transform(sums, lambda _, i: total(F.slice(sums, F.lit(1), i)))

    def sums(a: Column) -> Column:
        return let(
            starts(blocks(a)),
            lambda before: F.transform(
                a,
                lambda _, i: add(
                    F.get(before, F.floor(i / block).cast("int")),
                    total(F.slice(a, (F.floor(i / block) * block + 1).cast("int"), (i % block).cast("int"))),
                ),
            ),
        )

    return F.when(F.size(values) > 0, let(values, sums)).otherwise(F.array().cast("array<int>"))


def spans(text: Column, pattern: str, size=F.length) -> Column:
    """Leftmost non-overlapping matches of a Java pattern as array<struct<s,e,m>>: start, end, matched text. Places count
    code points, or what ``size`` counts in a string."""

    def build(gaps: Column, found: Column) -> Column:
        sizes = F.zip_with(
            F.slice(gaps, F.lit(1), F.size(found)),
            found,
            lambda g, m: F.struct(size(g).alias("g"), size(m).alias("m")),
        )
        return let(
            sizes,
            lambda z: let(
                prefix_sums(F.transform(z, lambda x: x["g"] + x["m"])),
                lambda before: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (F.get(before, i) + F.get(z, i)["g"]).alias("s"),
                        (F.get(before, i) + F.get(z, i)["g"] + F.get(z, i)["m"]).alias("e"),
                        m.alias("m"),
                    ),
                ),
            ),
        )

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(
        text.rlike(pattern),
        let(found, lambda m: let(F.split(text, pattern, -1), lambda g: build(g, m))),
    ).otherwise(no_spans())


def no_spans() -> Column:
    return F.array().cast("array<struct<s:int,e:int,m:string>>")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that no model may learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
