"""What the operators share: the folder all executors see, written tables, words, input tables."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import LIMITS, limited, new_path, shared_dir, tidy  # noqa: F401

#: Java and Python regex of one word: anything but the ASCII white space of the contracts.
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile("[^ \t-\r]+")
#: What str.split() also splits at, though the contracts do not.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words(text: str) -> list[str]:
    """The runs of anything but space, \\t, \\n, \\v, \\f and \\r."""
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def coded(texts: list[list[str]]) -> tuple[np.ndarray, list[str]]:
    """All words of all texts in order, as numbers of the different ones, and these."""
    found = pa.array(list(chain.from_iterable(texts)), pa.string()).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


def coded_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The same of the words of an array of texts, which are cut here; and how many words there are up to each text's end."""
    split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
    found = split.flatten().dictionary_encode()
    codes, distinct = found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()
    ends = np.cumsum(np.diff(split.offsets.to_numpy()))
    if "" not in distinct:
        return codes, distinct, ends
    full = codes != distinct.index("")  # white space at a text's end leaves an empty string
    return codes[full], distinct, np.append(0, np.cumsum(full))[ends]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and lost executors cost no rows."""
    spark = limited(df.sparkSession)
    path = new_path(spark, name)
    df.write.parquet(path)
    for made in _MADE:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """The tables that `written` makes inside are removed at its end: what was made of them must be saved by then."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield
    finally:
        _MADE.remove(made)
        for path in made:
            removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free(name: str, taken: list[str]) -> str:
    """The name, with as many underscores in front as no other column has."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


class Kept:
    """What a Python worker keeps between its tasks: one thing, and only while tasks of the same owner follow each other.

    Workers are used again by later stages; what an earlier stage kept would stand beside the later one's memory.
    """

    owner: str | None = None
    key: object = None
    value: object = None

    @classmethod
    def enter(cls, owner: str) -> None:
        if cls.owner != owner:
            cls.owner, cls.key, cls.value = owner, None, None
            cls.tidy()

    @classmethod
    def get(cls, key: object, make: Callable[[], object]):
        """The thing kept under the key; made anew, and what was kept let go first, if another key was asked for last."""
        if cls.value is None or cls.key != key:
            cls.key = cls.value = None
            cls.key, cls.value = key, make()
        return cls.value

    tidy = staticmethod(tidy)


def mapped(df: DataFrame, work: Callable, schema: str, owner: str) -> DataFrame:
    """df.mapInArrow(work, schema) in batches that are bounded in bytes, by workers that keep nothing of another owner."""
    limited(df.sparkSession)

    def bounded(batches):
        Kept.enter(owner)
        try:
            yield from work(batches)
        finally:
            Kept.tidy()

    return df.mapInArrow(bounded, schema)


@contextlib.contextmanager
def settings(spark: SparkSession, **conf):
    """Session settings for the jobs inside; __ in a name stands for a dot. What was set before comes back."""
    names = {k.replace("__", "."): str(v) for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def filtered_join(spark: SparkSession, n: int):
    """Settings under which a join on a written key table of n rows first filters its other side by a Bloom filter of the keys.

    The filter has 16 bits a key and 8 MB at most, so its size is bounded; past that it lets more rows through to the
    join, which is exact either way. The key table needs a filter of its own in the plan, else Spark makes none.
    """
    at = "spark__sql__optimizer__runtime__bloomFilter__"
    bits = min(max(1 << 16, 16 * n), 1 << 26)
    return settings(spark, **{f"{at}applicationSideScanSizeThreshold": "0b", f"{at}creationSideThreshold": "1t", f"{at}expectedNumItems": max(n, 1), f"{at}numBits": bits})
