"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word definition: space and the characters 9 to 13.
SPACE = r"\x20\x09-\x0D"


def fold(doc_id: Column, mod: int = 5) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def fold_of(doc_id: int | None, mod: int = 5) -> int:
    """fold() for one Python value."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def by_hash(h: Column, size: int, total: int) -> Column:
    """Whether a 64-bit hash falls into the fraction size / total, whatever the two are."""
    return F.lit(True) if total <= size else h.bitwiseAND(F.lit((1 << 63) - 1)) < F.lit((size << 63) // total)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


def own(df: DataFrame) -> list[Column]:
    """The columns of df, to be selected from a frame that has more, whatever they are called."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64) + 1
_LOWER[65:91] += 32
#: Bytes of texts that are hashed at a time; the numbers made of them take some forty times as much.
HASHED = 1_000_000


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose result's bits all depend on all of the argument's."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _factors(n: int) -> np.ndarray:
    """A fixed pseudo-random 64-bit factor for each place in a word."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' words one after the other, words of each text).

    Words are runs of other bytes than white space, A-Z made lower case. The
    hash is a sum of bytes times factors by place, mixed with the length: all
    words of a slice are hashed at once.
    """
    hashes, sizes, held, size = [], [], [], 0

    def flush():
        buffer = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
        inner = ~_SPACES[buffer]
        change = np.flatnonzero(np.diff(inner, prepend=False))
        starts, stops = change[::2], change[1::2]
        lengths = stops - starts
        if len(starts):
            at = np.flatnonzero(inner)
            place = at - np.repeat(starts, lengths)
            product = _LOWER[buffer[at]] * _factors(int(lengths.max()))[place]
            h = np.add.reduceat(product, np.cumsum(lengths) - lengths)
            hashes.append(mixed(h + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        ends = np.cumsum([len(b) + 1 for b in held])
        upto = np.searchsorted(starts, ends)
        sizes.append(np.diff(upto, prepend=0))

    for t in texts:
        b = t.encode("utf-8", "replace") if t else b""
        if held and size + len(b) > HASHED:
            flush()
            held, size = [], 0
        held.append(b)
        size += len(b)
    if held:
        flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)


#: A batch of rows is cut into slices of about so many characters before Python strings are made of it.
SLICE_CHARS = 8_000_000


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of the batch whose texts hold about SLICE_CHARS bytes each; one long text stays whole."""
    sizes = batch.column(column)
    lengths = pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > SLICE_CHARS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def release() -> None:
    """Give freed memory back to the system: worker processes outlive their tasks, and what they keep adds up beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_kept: dict = {}
_wanted: set = set()


def kept(key, make: Callable):
    """make()'s result, one large object a worker process, for later tasks that ask for the same key: a task that doesn't ask drops it."""
    _wanted.add(key)
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


@contextlib.contextmanager
def starting() -> Iterator[None]:
    """Around the start of a task: what earlier ones kept goes, unless it is asked for inside."""
    _wanted.clear()
    yield
    for key in [k for k in _kept if k not in _wanted]:
        del _kept[key]
        release()


def per_document(docs: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., dict[str, list]]]) -> DataFrame:
    """Map rows of docs in Arrow batches.

    make() runs once a task and returns a function from a {column: list} slice
    to a {column: list} of results, row for row or not. Only `columns` are
    sent to Python, so other columns of docs cannot clash with anything.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with starting():
            each = make()
        for batch in batches:
            for part in slices(batch, columns[-1]):
                out = each({c: part.column(c).to_pylist() for c in columns})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
                del out
            release()

    return docs.select(*columns).mapInArrow(run, schema)
