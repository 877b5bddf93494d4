"""CRC-32 in SQL, for the oracles of engines that lack it."""

#: The 256 remainders of single bytes, from the reversed polynomial.
CRC_TABLE = """list_transform(range(256), lambda byte: list_reduce(
    list_prepend(byte, range(8)), lambda rest, bit: CASE WHEN rest & 1 = 1 THEN xor(rest >> 1, 3988292384) ELSE rest >> 1 END))"""


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string expression; the column crc_table must hold CRC_TABLE."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
    lambda rest, byte: xor(rest >> 8, crc_table[1 + (xor(rest, byte) & 255)])), 4294967295)"""
