"""How much goes into a chunk, a part and a batch, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least bytes of a chunk, chunks that decode together, slack of a chunk's bit stream.
FLOOR, TARGET, SLACK = 65_536, 128, 64


def chunk_size(total: Column, target: int = TARGET, pin: int | None = None) -> Column:
    """Bytes of a chunk for a total: FLOOR, or what makes 4 * target chunks (16 at least) if that is more. Null for null."""
    if pin is not None:
        return F.when(total.isNotNull(), F.lit(int(pin)).cast("long"))
    n = max(4 * target, 16)
    total = total.cast("long")
    return F.when(total <= 0, F.lit(FLOOR).cast("long")).when(total.isNotNull(), F.greatest(F.lit(FLOOR).cast("long"), quotient(total + (n - 1), F.lit(n))))


def quotient(a: Column, b: Column) -> Column:
    """Whole quotient, without a detour over doubles."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def part_range(part: Column, parts: Column, total: Column, **sizing) -> tuple[Column, Column]:
    """First byte and end of a part. Parts are whole chunks, the last takes the rest, and parts beyond the total are empty at its end."""
    total, size = total.cast("long"), chunk_size(total, **sizing)
    per = F.greatest(quotient(quotient(total, parts), size) * size, size)
    start = F.least(part.cast("long") * per, total)
    end = F.when(part == parts - 1, total).otherwise(F.least((part.cast("long") + 1) * per, total))
    return start, end


def index_range(part: Column, parts: Column, chunks: Column) -> tuple[Column, Column]:
    """First chunk and end of a part, when chunks are dealt out by their number; parts differ by less than one share."""
    per = F.ceil(chunks / parts).cast("long")
    return F.least(part.cast("long") * per, chunks.cast("long")), F.least((part.cast("long") + 1) * per, chunks.cast("long"))


def decode_batch(chunks: int, cores: int, per_core: int = 8, memory: int | None = None, each: int = 1_500_000) -> int:
    """Chunks to decode together: per_core for each core, within 80 % of the memory, and no more than there are."""
    n = max(1, cores * per_core)
    if memory:
        n = min(n, max(1, int(0.8 * memory) // each))
    return max(1, min(n, chunks)) if chunks > 0 else 1


def decode_batches(chunks: Column, cores: int, per_core: int = 8, memory: int | None = None, each: int = 1_500_000) -> Column:
    """decode_batch() for a column of numbers of chunks."""
    most = decode_batch(2**31, cores, per_core, memory, each)
    return F.when(chunks > 0, F.least(F.lit(most).cast("long"), chunks.cast("long"))).when(chunks.isNotNull(), F.lit(1).cast("long"))
