"""Drawing rows of a ranked pool by arithmetic, so that no profile ever meets the whole pool.

A pool has positions ``0..M-1``. A draw of N takes positions ``(h + k*s) mod M`` for ``k = 0..N-1``,
where ``h`` is a 60-bit number from the key's hash and ``s`` is, modulo M, a prime that does not divide M.
These are ``min(N, M)`` different positions, spread over the whole pool, found without looking at it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voicegrain.operators.ranking import hash_number

# The least primes above 10^15 times the square roots of 2, 3, 5, 6, 7, 8, 10 and 11. They exceed any
# pool and are no near multiple of round numbers, so that their remainders spread over it; only a multiple of all
# of them could be divisible by each.
PRIME_STRIDES = [
    1414213562373113,
    1732050807568919,
    2236067977499803,
    2449489742783179,
    2645751311064599,
    2828427124746217,
    3162277660168399,
    3316624790355451,
]


def stride(seed, pool: Column, *keys) -> Column:
    """The remainder of one of the primes that do not divide the pool size, picked by the key's hash."""
    usable = F.filter(F.array(*[F.lit(p).cast("bigint") for p in PRIME_STRIDES]), lambda p: pool % p != 0)
    return F.element_at(usable, (hash_number(f"{seed}-stride", *keys) % F.size(usable) + 1).cast("int")) % pool


def draw(seed, pool: Column, n, *keys) -> Column:
    """Array of ``min(n, pool)`` different positions of the pool; empty when the pool is."""
    n = n if isinstance(n, Column) else F.lit(n)
    size = F.greatest(pool, F.lit(1))  # an empty pool gives no steps
    count = F.least(n, pool).cast("bigint")
    # a lambda's body is evaluated for every element, so the hashes come to it as fields that are there already
    row = F.struct((hash_number(seed, *keys) % size).alias("start"), stride(seed, size, *keys).alias("step"), size.alias("size"))
    steps = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    drawn = F.transform(F.array(row), lambda r: F.transform(steps, lambda k: (r["start"] + k * r["step"]) % r["size"]))
    return F.element_at(drawn, 1)


def draw_others(seed, users: Column, self_position: Column, n, *keys) -> Column:
    """Positions of ``min(n, users - 1)`` other users; all users when the own position is null.

    The offset from the own position is never a multiple of the pool size, so self cannot be drawn.
    """
    others = users - F.when(self_position.isNotNull(), 1).otherwise(0)
    own = F.coalesce(self_position, F.lit(-1).cast("bigint"))
    return F.transform(draw(seed, others, n, *keys), lambda d: (own + 1 + d) % users)
