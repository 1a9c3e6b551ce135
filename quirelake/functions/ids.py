"""Stable record ids: a 128-bit multiplicative hash over UTF-8 bytes, written as a UUID.

h starts at 0xcbf29ce484222325; for each byte h = (h xor byte) * 0x100000001b3
modulo 2**128; a NUL byte stands between parts. The state is held in four 32-bit
limbs, so that every product fits a long.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column) -> Column:
    text = F.concat_ws("\0", *[p.cast("string") for p in parts])
    # One character for each byte, all made at once: what a lambda takes from outside is made anew for each of its elements.
    data = F.transform(F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c).cast("long"))
    mask = (1 << 32) - 1

    def step(h: Column, byte: Column) -> Column:
        # The multiplier is 2**40 + 435: limbs move up by one and 8 bits, plus 435 times each limb.
        l0, l1, l2, l3 = h.l0.bitwiseXOR(byte), h.l1, h.l2, h.l3
        s0 = l0 * 435
        s1 = l1 * 435 + F.shiftleft(l0, 8) + F.shiftright(s0, 32)
        s2 = l2 * 435 + F.shiftleft(l1, 8) + F.shiftright(s1, 32)
        s3 = l3 * 435 + F.shiftleft(l2, 8) + F.shiftright(s2, 32)
        return F.struct(*[s.bitwiseAND(F.lit(mask)).alias(f"l{k}") for k, s in enumerate((s0, s1, s2, s3))])

    seed = F.struct(F.lit(0x84222325).alias("l0"), F.lit(0xCBF29CE4).alias("l1"), F.lit(0).cast("long").alias("l2"), F.lit(0).cast("long").alias("l3"))
    seed = seed.cast("struct<l0: long, l1: long, l2: long, l3: long>")
    digits = F.aggregate(data, seed, step, lambda h: F.concat(*[F.lpad(F.lower(F.hex(h[f"l{k}"])), 8, "0") for k in (3, 2, 1, 0)]))
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
