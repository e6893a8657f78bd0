"""Pieces of checking SQL that several queries share."""


def crc32_sql(text: str) -> str:
    """crc32 of a text of characters below U+0800 as UTF-8, bit by bit."""
    code = "unicode(c)"
    byte = f"CASE WHEN {code} < 128 THEN [{code}] ELSE [192 + ({code} >> 6), 128 + ({code} & 63)] END"
    bits = f"flatten(list_transform(flatten(list_transform(string_split({text}, ''), lambda c: {byte})), lambda b: [b::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(s, x) >> 1, 3988292384 * (xor(s, x) & 1))"
    return f"CASE WHEN {text} = '' THEN 0 ELSE xor(list_reduce({bits}, lambda s, x: {step}, 4294967295::BIGINT), 4294967295) END"
