"""Hashes and encodings by name. What Spark has stays in the JVM; the rest is Arrow-batched."""

from __future__ import annotations

import hashlib
import hmac
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_M = (1 << 64) - 1


def _rotate(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & _M


def _finish(k: int) -> int:
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        k = ((k ^ (k >> 33)) * c) & _M
    return k ^ (k >> 33)


def murmur3_128(data: bytes, seed: int = 0) -> bytes:
    """The public 128-bit x64 variant; the two halves in little-endian order."""
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    h1 = h2 = seed
    whole = len(data) // 16 * 16
    scramble1 = lambda k: (_rotate((k * c1) & _M, 31) * c2) & _M
    scramble2 = lambda k: (_rotate((k * c2) & _M, 33) * c1) & _M
    for k1, k2 in struct.iter_unpack("<QQ", data[:whole]):
        h1 = ((_rotate(h1 ^ scramble1(k1), 27) + h2) * 5 + 0x52DCE729) & _M
        h2 = ((_rotate(h2 ^ scramble2(k2), 31) + h1) * 5 + 0x38495AB5) & _M
    tail = data[whole:]
    if len(tail) > 8:
        h2 ^= scramble2(int.from_bytes(tail[8:], "little"))
    if tail:
        h1 ^= scramble1(int.from_bytes(tail[:8], "little"))
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & _M
    h2 = (h2 + h1) & _M
    h1, h2 = _finish(h1), _finish(h2)
    h1 = (h1 + h2) & _M
    return struct.pack("<QQ", h1, (h2 + h1) & _M)


def djb2(data: bytes, seed: int = 5381) -> int:
    """The sum of each byte times 33 to the power of the bytes after it, and the seed ahead of them, in 32 bits."""
    n = len(data)
    powers = np.full(n + 1, 33, np.uint32)
    powers[0] = 1
    powers = np.multiply.accumulate(powers, dtype=np.uint32)[::-1]
    return (int((np.frombuffer(data, np.uint8) * powers[1:]).sum(dtype=np.uint32)) + seed * int(powers[0])) & 0xFFFFFFFF


def _numbers(name: str, one):
    @F.pandas_udf(T.LongType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: one(bytes(x)), na_action="ignore").astype("Int64")

    run.__name__ = name
    return run


def _texts(name: str, one):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: one(bytes(x)), na_action="ignore")

    run.__name__ = name
    return run


_adler32 = _numbers("adler32", zlib.adler32)
_djb2 = _numbers("djb2", djb2)
_murmur = _texts("murmur3_128", lambda x: murmur3_128(x).hex())


def adler32(data: Column) -> Column:
    return _adler32(data.cast("binary"))


def djb2_hash(data: Column) -> Column:
    return _djb2(data.cast("binary"))


def hash_by_name(name: str, data: Column) -> Column:
    """Lower-case hex (numbers as 8 hex digits) of a binary or string column. RIPEMD needs a Python whose OpenSSL has it."""
    key = name.lower().replace("-", "").replace("_", "")
    binary = data.cast("binary")
    if key == "md5":
        return F.md5(binary)
    if key in ("sha1", "sha160"):
        return F.sha1(binary)
    if key in ("sha224", "sha256", "sha384", "sha512"):
        return F.sha2(binary, int(key[3:]))
    if key == "crc32":
        return F.lpad(F.lower(F.hex(F.crc32(binary))), 8, "0")
    if key == "crc32mpeg2":
        return F.lpad(F.lower(F.hex(crc32_mpeg(binary))), 8, "0")
    if key == "adler32":
        return F.lpad(F.lower(F.hex(_adler32(binary))), 8, "0")
    if key in ("murmur3", "murmur3128"):
        return _murmur(binary)
    other = {"sha512224": "sha512_224", "sha512256": "sha512_256", "ripemd160": "ripemd160"}.get(key.replace("/", ""))
    if other and other in hashlib.algorithms_available:
        return _texts(other, lambda x: hashlib.new(other, x).hexdigest())(binary)
    raise ValueError(f"no hash named {name!r} here")


#: Each byte that is not its own mirror image, and its bits in the opposite order, as characters.
_BYTES = [b for b in range(256) if int(f"{b:08b}"[::-1], 2) != b]
_MIRRORED = "".join(map(chr, _BYTES)), "".join(chr(int(f"{b:08b}"[::-1], 2)) for b in _BYTES)


def _mirrored_crc32(data: Column) -> Column:
    return F.crc32(F.encode(F.translate(F.decode(data.cast("binary"), "ISO-8859-1"), *_MIRRORED), "ISO-8859-1"))


def crc32_mpeg(data: Column) -> Column:
    """The CRC-32 that takes each byte's highest bit first and does not invert its result: the common one's mirror image."""
    mirrored = F.conv(F.reverse(F.lpad(F.bin(_mirrored_crc32(data)), 32, "0")), 2, 10).cast("long")
    return F.lit((1 << 32) - 1).bitwiseXOR(mirrored)


def ends_in_crc32_mpeg(data: Column) -> Column:
    """Whether the last four bytes are the crc32_mpeg() of those before them: over all bytes it is then 0."""
    return _mirrored_crc32(data) == (1 << 32) - 1


def hmac_hex(name: str, key: bytes, data: Column) -> Column:
    return _texts(f"hmac_{name}", lambda x: hmac.new(key, x, name).hexdigest())(data.cast("binary"))


def unhex_strict(text: Column) -> Column:
    """Null for an odd number of digits or anything that is no hex."""
    return F.when((F.length(text) % 2 == 0) & text.rlike("^[0-9A-Fa-f]*$"), F.unhex(text))


def read_number(data: Column, at: int | Column, size: int, little: bool = False) -> Column:
    """An unsigned number of up to 7 bytes from place `at`, big-endian unless little."""
    part = F.substring(data, F.lit(at + 1) if isinstance(at, int) else at + 1, F.lit(size))
    digits = F.hex(part)
    if little:
        digits = F.array_join(F.reverse(F.regexp_extract_all(F.hex(part), F.lit("(..)"), F.lit(1))), "")
    return F.conv(digits, 16, 10).cast("long")


def read_bits(data: Column, first_bit: int, n: int) -> Column:
    """n bits (up to 48) from a bit place, most significant first."""
    start, end = first_bit // 8, (first_bit + n + 7) // 8
    return F.shiftright(read_number(data, start, end - start), end * 8 - first_bit - n).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def bit_text(data: Column) -> Column:
    """The bits of a binary column, as text of 0 and 1."""
    return F.array_join(F.transform(F.regexp_extract_all(F.hex(data), F.lit("(.)"), F.lit(1)), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")


def exp_golomb_at(bits: Column, at: Column | int = 0) -> Column:
    """struct<value, next>: the unsigned Exp-Golomb number that begins at a bit place of a text of bits, and where it ends;
    null where the code is cut short (codes of up to 62 bits)."""
    at = F.lit(at) if isinstance(at, int) else at
    rest = F.substring(bits, at + 1, F.length(bits))
    zeros = F.instr(rest, "1") - 1
    value = F.conv(F.substring(rest, zeros + 1, zeros + 1), 2, 10).cast("long") - 1
    return F.when((zeros >= 0) & (2 * zeros + 1 <= F.length(rest)), F.struct(value.alias("value"), (at + 2 * zeros + 1).alias("next")))


def signed_golomb_of(value: Column) -> Column:
    """The signed number that an unsigned Exp-Golomb number stands for: 0, 1, -1, 2, -2, ..."""
    return F.when(value % 2 == 1, F.floor((value + 1) / 2)).otherwise(-F.floor(value / 2)).cast("long")


def exp_golomb(bits: str) -> tuple[int, str]:
    """The unsigned number that a string of 0 and 1 begins with, and what is left."""
    zeros = len(bits) - len(bits.lstrip("0"))
    end = 2 * zeros + 1
    if end > len(bits):
        raise ValueError("the code is cut short")
    return int(bits[zeros:end], 2) - 1, bits[end:]


def signed_golomb(bits: str) -> tuple[int, str]:
    n, rest = exp_golomb(bits)
    return ((n + 1) // 2 if n % 2 else -(n // 2)), rest


def base64_text(data: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(data.cast("binary")), "[\\r\\n]", "")


def from_base64(text: Column) -> Column:
    """The bytes, null for a text that is no base64."""
    return F.when(text.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.length(text) % 4 == 0), F.unbase64(text))


def double_of(data: Column, at: int = 0) -> Column:
    """The number in eight big-endian bytes of IEEE double precision."""
    high, low = read_number(data, at, 4), read_number(data, at + 4, 4)
    sign = F.when(F.shiftright(high, 31) == 1, -1.0).otherwise(1.0)
    exponent = F.shiftright(high, 20).bitwiseAND(F.lit(0x7FF))
    fraction = high.bitwiseAND(F.lit(0xFFFFF)).cast("double") * F.lit(2.0**-20) + low.cast("double") * F.lit(2.0**-52)
    special = F.when(fraction == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    small = sign * fraction * F.lit(2.0**-1022)
    return F.when(exponent == 0x7FF, special).when(exponent == 0, small).otherwise(sign * (1 + fraction) * F.pow(F.lit(2.0), (exponent - 1023).cast("double")))


def all_flags(value: Column, mask: int) -> Column:
    """Whether all bits of the mask are set."""
    return value.bitwiseAND(F.lit(mask)) == mask


def decrypt_cbc(data: Column, key: Column, iv: Column) -> Column:
    """AES-CBC with its padding; the iv goes before the data."""
    return F.aes_decrypt(F.concat(iv, data), key, F.lit("CBC"))


def sequence_iv(sequence: Column) -> Column:
    """16 bytes, zero but for the sequence number in the last four, big-endian."""
    return F.unhex(F.lpad(F.hex(sequence.cast("long")), 32, "0"))
