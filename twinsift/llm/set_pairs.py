"""Which pairs of shingle sets are similar enough, by their whole sets.

Pairs are grouped by their first set. A group's first set travels once to each of its parts and
stays there while the others pass by, one at a time: a set is shipped once per pair, not two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.skew import with_aggregates
from twinsift.staging import small_side, stage_counted

#: Pairs of one first set that are compared in one task.
GROUP = 512


def _compare(percent: int, kind: pa.DataType):
    """The links of groups that come in order, each with its first set, without ``b``, before the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, own = None, None
        for batch in batches:
            a, b = [], []
            for group, other, members in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "members"))):
                members = np.frombuffer(members, np.uint64)
                if other is None:
                    first, own = group, members
                elif group == first:
                    common = len(np.intersect1d(own, members, assume_unique=True))
                    if 100 * common >= percent * (len(own) + len(members) - common):
                        a.append(group)
                        b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

    return run


def linked_pairs(pairs: DataFrame, n: int, sets: DataFrame, percent: int, group: int = GROUP) -> tuple[DataFrame, int]:
    """The links among ``n`` staged distinct pairs ``(a, b)``, and their number.

    ``sets(name, members)`` has the sorted 64-bit hashes of every set that a pair names; a set may
    come several times.
    """
    kind = dict(pairs.dtypes)["a"]
    salted = with_aggregates(pairs, ["a"], {}, n).selectExpr("a", "b", f"pmod(xxhash64(b), ceil(_rows / {group})) as salt")
    others = small_side(salted, n).join(sets.withColumnRenamed("name", "b"), "b").select("a", "salt", "b", "members")
    firsts = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("name", "a"), "a")
    both = others.unionByName(firsts.withColumn("b", F.lit(None).cast(kind)))
    dealt = both.repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    arrow = pa.binary() if kind == "binary" else pa.int64()
    return stage_counted(dealt.mapInArrow(_compare(percent, arrow), f"a {kind}, b {kind}").distinct(), "links")
