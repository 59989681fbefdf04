"""URL filters by a sort-merge range join of addresses with nested rules.

A host is keyed by its labels in reverse, so that the hosts a rule covers are an interval of keys,
and the paths it covers are an interval within each host. Addresses are range-partitioned by key
and path; every partition gets the rules whose intervals reach into it and sweeps rules and
addresses in one sorted pass, with a stack of the rules open for the host and, within it, a stack
of those open for the path. Intervals nest, so both are stacks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallybook.llm.common import others, prepare, quoted, rest

RESULTS = ["host", "path", "rule", "verdict"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of an address; both empty without ``://``.

    The host runs from behind the first ``://`` to the next ``/``, ``?``, ``#`` or the end, with
    A-Z lower-cased; the path from there to ``?``, ``#`` or the end.
    """
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def host_key(host: Column) -> Column:
    """The labels in reverse, each between control characters that labels cannot hold unescaped.

    Hosts below another share its key as a prefix, and only they do.
    """
    plain = F.replace(F.replace(host, F.lit("\x02"), F.lit("\x02\x02")), F.lit("\x01"), F.lit("\x02\x03"))
    labels = F.reverse(F.split(plain, r"\."))
    return F.concat(F.lit("\x01"), F.array_join(labels, "\x01"), F.lit("\x01"))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    sample_per_part: int = 64,
) -> DataFrame:
    """The columns of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). A rule fits its host and all
    hosts below it if the path starts with the rule's path. The longest rule, host and path taken
    together, wins; among rules of one length the one with the longer host, and of equal rules
    block. ``rule`` is the winner's host and path, null if none fits, and the verdict is then
    ``default``. Null addresses and those without ``://`` have an empty host and path. Rules with
    nulls are ignored, repeated rows each come out, and input columns of the result's names are
    replaced.

    Partition bounds come from a sample of about ``sample_per_part`` addresses for each partition;
    they decide how work is dealt out, never what is found. One address held by most rows is split
    by a hash of its row's id.
    """
    spark = prepare(pages.sparkSession)
    host, path = url_parts(quoted(url_col))
    keyed = pages.select(
        host.alias("host"),
        path.alias("path"),
        F.xxhash64(quoted(id_col), quoted(url_col)).alias("salt"),
        rest(pages, RESULTS).alias("rest"),
    ).select(host_key(F.col("host")).alias("key"), "path", "salt", "host", "rest")
    opened = (
        rules.select("host", "path", "verdict")
        .na.drop()
        .groupBy(F.lower("host").alias("host"), "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(host_key(F.col("host")).alias("key"), "path", "host", "verdict")
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    bounds = _bounds(keyed, parts, sample_per_part)

    asking = keyed.mapInArrow(_assign(bounds), _with_part(keyed)).select(
        "part", "key", F.lit(1).alias("kind"), "path", "host", F.lit(None).cast("string").alias("verdict"), "rest"
    )
    reaching = opened.mapInArrow(_reach(bounds), _with_part(opened)).select(
        "part", "key", F.lit(0).alias("kind"), "path", "host", "verdict",
        F.lit(None).cast(keyed.schema["rest"].dataType).alias("rest"),
    )
    dealt = asking.unionByName(reaching).repartition("part").sortWithinPartitions("part", "key", "kind", "path")
    own = StructType.fromDDL("host string, path string, rule string, verdict string")
    judged = dealt.mapInArrow(_sweep(default), StructType([keyed.schema["rest"], *own]))
    kept = [F.col("rest").getField(n).alias(n) for n in others(pages, RESULTS)]
    return judged.select(*kept, *RESULTS)


def _with_part(df: DataFrame) -> StructType:
    return StructType([StructField("part", IntegerType()), *df.schema])


def _bounds(keyed: DataFrame, parts: int, sample_per_part: int) -> list[tuple]:
    """At most ``parts - 1`` places that cut a sample of the addresses into equal parts."""
    wanted = parts * sample_per_part
    share = min(1.0, wanted / max(keyed.count(), 1))
    rows = keyed.select("key", "path", "salt").sample(False, share, 5).limit(2 * wanted).collect()
    places = sorted(tuple(r) for r in rows)
    return [places[len(places) * i // parts] for i in range(1, parts)] if places else []


def _assign(bounds: list[tuple]):
    """Task function: the part of each address."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            places = zip(*[rows.column(c).to_pylist() for c in ("key", "path", "salt")])
            part = pa.array([bisect_left(bounds, place) for place in places], pa.int32())
            yield pa.RecordBatch.from_arrays([part, *rows.columns], names=["part", *rows.schema.names])

    return run


def _reach(bounds: list[tuple]):
    """Task function: each rule once for every part its hosts reach into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys = rows.column("key").to_pylist()
            spans = [
                range(bisect_left(bounds, (k,)), bisect_left(bounds, (k + "\U0010ffff",)) + 1) for k in keys
            ]
            at = pa.array([i for i, span in enumerate(spans) for _ in span], pa.int64())
            part = pa.array([p for span in spans for p in span], pa.int32())
            found = rows.take(at)
            yield pa.RecordBatch.from_arrays([part, *found.columns], names=["part", *rows.schema.names])

    return run


def _sweep(default: str):
    """Task function over rules and addresses sorted by part, key and path."""

    def better(a: tuple, b: tuple | None) -> tuple:
        return a if b is None or (len(a[0]) + len(a[1]), len(a[0])) > (len(b[0]) + len(b[1]), len(b[0])) else b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = key = None
        hosts: list[tuple] = []  # Open rules: key, path, host, verdict. Keys are prefixes of each other.
        coming: list[tuple] = []  # Rules of the current host by path, the next one last.
        paths: list[tuple] = []  # Open rules: path and the best rule so far. Paths are prefixes of each other.
        for rows in batches:
            chosen, rules, verdicts = [], [], []
            names = ("part", "key", "kind", "path", "host", "verdict")
            for i, (part, k, kind, path, host, verdict) in enumerate(zip(*[rows.column(c).to_pylist() for c in names])):
                if (part, k) != (here, key):
                    if part != here:
                        hosts = []
                    while hosts and not k.startswith(hosts[-1][0]):
                        hosts.pop()
                    here, key, coming, paths = part, k, None, []
                if kind == 0:
                    hosts.append((k, path, host, verdict))
                    continue
                if coming is None:
                    coming = sorted(((p, h, v) for _, p, h, v in hosts), reverse=True)
                while paths and not path.startswith(paths[-1][0]):
                    paths.pop()
                while coming and coming[-1][0] <= path:
                    p, h, v = coming.pop()
                    if path.startswith(p):
                        paths.append((p, better((h, p, v), paths[-1][1] if paths else None)))
                found = paths[-1][1] if paths else None
                chosen.append(i)
                rules.append(found[0] + found[1] if found else None)
                verdicts.append(found[2] if found else default)
            if chosen:
                kept = rows.take(pa.array(chosen, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*[kept.column(c) for c in ("rest", "host", "path")], pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                    names=["rest", "host", "path", "rule", "verdict"],
                )

    return run
