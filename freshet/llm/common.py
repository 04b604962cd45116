"""What the operators share: the two document columns they read, Arrow batches and polynomial hashes.

Every operator reads an id and a text column and ignores all others, so extra columns and their names
do not matter. A null text counts as the empty text. Ids may be null and may repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handled together inside a task: at most this many characters, or one text.
CHUNK_CHARS = 500_000

#: Odd multiplier of the polynomial hashes and the seed of the byte table they use.
BASE = 0x9E3779B97F4A7C15
TABLE = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest()[:8] for i in range(256)), dtype="<u8").copy()


#: Rows and bytes that Spark hands to Python at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to ``BATCH``, as whole texts in default batches take much memory.

    Spark reads the limits when a plan runs, so they stay lowered; results do not depend on them.
    """
    for name, most in BATCH.items():
        held = spark.conf.get(name)  # a count, or bytes as "8388608b"; other ways to write bytes are left alone
        if held.removesuffix("b").isdigit() and not 0 < int(held.removesuffix("b")) <= most:
            spark.conf.set(name, str(most))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as ``doc_id`` and the text as ``text``, null texts as empty ones."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )


def pieces(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``limit`` characters together, or of one text."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if i > begin and held + len(text) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def map_texts(df: DataFrame, columns: Callable[[list[str]], dict], fields: dict[str, tuple[str, pa.DataType]], done: Callable[[], None] | None = None) -> DataFrame:
    """Add columns computed from ``text``; ``columns`` maps a list of texts to arrays by name.

    ``done`` is called when a task has seen all its rows, to let go of what it held.

    ``fields`` gives each new column's Spark and Arrow type. All other columns but ``text`` pass through.
    """
    kept = [c for c in df.columns if c != "text"]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"`{n}` {t[0]}" for n, t in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").to_pylist()
            for begin, end in pieces(texts):
                made = columns(texts[begin:end])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(begin, end - begin) for c in kept]
                    + [v if isinstance(v := made[n], pa.Array) else pa.array(v, type=t[1]) for n, t in fields.items()],
                    names=kept + list(fields),
                )
        if done is not None:
            done()

    return df.mapInArrow(run, schema)


def with_row(df: DataFrame) -> DataFrame:
    """Add ``row``, a hash of the text; with the id it names a row, or rows that are equal anyway."""
    return df.withColumn("row", F.xxhash64("text"))


def filter_texts(docs: DataFrame, keep: Callable[[list[str]], list[bool]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose text ``keep`` accepts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            for begin, end in pieces(texts):
                yield batch.slice(begin, end - begin).filter(pa.array(keep(texts[begin:end]), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def rows_in(docs: DataFrame, named: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id and text are among those named by the stored ``doc_id, row`` (``left_semi``) or not (``left_anti``)."""
    mark = docs.withColumns({"_named_id": F.col(f"`{id_col}`").cast("long"), "_named_row": F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))})
    return join_small(mark, named.select(F.col("doc_id").alias("_named_id"), F.col("row").alias("_named_row")), ["_named_id", "_named_row"], how).drop("_named_id", "_named_row")


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.empty(n + 1, dtype=np.uint64)
    out[0] = 1
    out[1:] = base & (2**64 - 1)
    return np.multiply.accumulate(out)[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit hashes over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def release() -> None:
    """Give back what a worker process keeps between tasks: grown tables and Arrow's unused memory."""
    _grown.clear()
    pa.default_memory_pool().release_unused()


INVERSE = pow(BASE, -1, 2**64)
_grown: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    held = _grown.get(name)
    if held is None or len(held) < n:
        held = _grown[name] = powers(max(n, 1 << 16), base)
        if len(held) > 1 << 22:
            del _grown[name]
    return held[:n]


def prefix_hashes(data: bytes, second: bool = False) -> np.ndarray:
    """Sums from which ``span_hashes`` takes the hash of any stretch of ``data``; ``second`` for another 64 bits."""
    values = (mix(TABLE) if second else TABLE)[np.frombuffer(data, dtype=np.uint8)]
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _table("up", BASE, len(values)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [begin, end) of the data behind ``sums``; equal bytes, equal hash."""
    raw = (sums[end] - sums[begin]) * _table("down", INVERSE, len(sums) + 1)[begin]
    return mix(raw + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: A table of at most this many bytes may be broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 48 << 20


def join_small(left: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join a stored table that is usually small, null keys matching null keys.

    Its size is measured: up to ``BROADCAST_BYTES`` it is broadcast, beyond that both sides are shuffled.
    """
    size = F.lit(0)
    for f in small.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        size = size + (F.coalesce(F.size(c), F.lit(0)) * 8 if kind == "array" else F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(0)) + 16
    held = small.agg(F.sum(size.cast("long"))).first()[0] or 0
    right = small.withColumnsRenamed({c: f"_right_{c}" for c in on})
    if held <= BROADCAST_BYTES:
        right = F.broadcast(right)
    match = F.lit(True)
    for c in on:
        match = match & left[c].eqNullSafe(right[f"_right_{c}"])
    return left.join(right, match, how).drop(*[f"_right_{c}" for c in on])


def word_spans(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words joined by one space, with the begin and end of each."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(sizes + 1) - 1
    return b" ".join(words), end - sizes, end


def encode(text: str) -> bytes:
    """UTF-8; lone surrogates, which no valid table holds, become question marks."""
    return text.encode("utf-8", "replace")
