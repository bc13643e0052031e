"""Column functions over text. All of them are built-in expressions, so they stay inside codegen."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented Latin letters and their base letter, from the Unicode decomposition.
_ACCENTED = [
    (chr(cp), unicodedata.normalize("NFKD", chr(cp))[0])
    for cp in range(0x00C0, 0x0180)
    if unicodedata.normalize("NFKD", chr(cp))[0].isascii()
]
_ACCENT_FROM = "".join(a for a, _ in _ACCENTED)
_ACCENT_TO = "".join(b for _, b in _ACCENTED)

# Broken UTF-8 pairs and the text they stand for.
MOJIBAKE_PAIRS = {
    "Ã¡": "á", "Ã©": "é", "Ã\xad": "í", "Ã³": "ó", "Ãº": "ú",
    "ÃÁ": "Á", "Ã‰": "É", "Ã\x8d": "Í", "Ã“": "Ó", "Ãš": "Ú",
    "Ã±": "ñ", "Ã‘": "Ñ",
    "Â": "",
    "Ã ": "à", "Ã¨": "è", "Ã¬": "ì", "Ã²": "ò", "Ã¹": "ù",
}

# Catalogue repairs applied after the pairs, in this order.
CATALOG_REPAIRS = {
    r"HidrataciÃ³n": "Hidratación",
    r"Geles EnergÃ©ticos": "Geles Energéticos",
    r"ProteÃ\xadnas": "Proteínas",
    r"CÃ¡psula?s?": "Cápsula",
    r"EnergÃ\xada": "Energía",
    r"BaÃ±o": "Baño",
    r"A3n": "ón", r"A1": "á", r"A9": "é", r"A\(c\)": "é", r"Aa": "á",
    r"CA!psulas": "Cápsulas",
    r"Energá": "Energía",
    r"Geles EnergA\(c\)ticos": "Geles Energéticos",
    r"CosmA\(c\)tica": "Cosmética",
    r"TA\(c\), Infusiones y Rooibos": "Té, Infusiones y Rooibos",
    r"CafA\(c\) y expreso": "Café y expreso",
    r"BaA\+\-o e higiene personal": "Baño e higiene personal",
    r"éeites Esenciales": "Aceites Esenciales",
    r"éeites, vinagres y aliA\+\-os": "Aceites, vinagres y aliños",
    r"Perfumerá": "Perfumería",
    r"ProteAnas": "Proteínas",
}

# Unit words of product names.
UNIT_WORDS = r"(ml|g|gr|gramos|capsulas?|uds|unidades)\b"

# Categories sold by volume and by weight.
VOLUME_CATEGORY = r"(gel|geles|isoton|hidrataci[oó]n|bebida)"
WEIGHT_CATEGORY = r"(barrita|barritas|amino|prote[ií]n|creatina|carbohidratos?)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_product_id(c) -> Column:
    """``1000.0``, ``" 1000 "`` and ``001000`` become ``1000``; empty text and ``nan`` become null.

    Only digits are rewritten, however many there are; ids such as ``12D`` or ``A-7`` stay as they are.
    """
    text = F.trim(_col(c).cast("string"))
    empty = (text == "") | F.lower(text).isin("nan", "none", "<na>", "null")
    whole = F.regexp_replace(text, r"^\+?(-?)0*([0-9]+)(?:\.0*)?$", "$1$2")
    return F.when(text.isNull() | empty, F.lit(None).cast("string")).otherwise(whole)


def strip_accents(c) -> Column:
    """Base letters for accented ones; what has no ASCII form is dropped."""
    return F.regexp_replace(F.translate(_col(c), _ACCENT_FROM, _ACCENT_TO), r"[^\x00-\x7F]", "")


def collapse_spaces(c) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def normalize_category_text(c, drop_symbols: bool = False) -> Column:
    out = collapse_spaces(strip_accents(F.lower(_col(c))))
    if drop_symbols:
        out = F.trim(F.regexp_replace(out, r"[^a-z0-9\s\-/&]", ""))
    return out


def slugify(c) -> Column:
    dashed = F.regexp_replace(F.lower(strip_accents(_col(c))), r"[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, r"^-+|-+$", "")


def fix_mojibake(c) -> Column:
    """Pairs first, each as a plain replacement in the fixed order."""
    out = _col(c)
    for bad, good in MOJIBAKE_PAIRS.items():
        out = F.replace(out, F.lit(bad), F.lit(good))
    return out


def repair_catalog_text(c) -> Column:
    out = collapse_spaces(fix_mojibake(c))
    for pattern, good in CATALOG_REPAIRS.items():
        out = F.regexp_replace(out, pattern, good)
    return out


def header_slug(name: str) -> str:
    """Driver-side form of a header: no byte-order mark, no accents, lower case, underscores for ``/ - . ,`` and spaces."""
    plain = unicodedata.normalize("NFKD", name.replace("﻿", "").strip())
    letters = "".join(ch for ch in plain if not unicodedata.combining(ch)).lower()
    return "_".join(letters.translate(str.maketrans("/-.,", "    ")).split())


def normalize_headers(df: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Rename every column to its slug, then to the canonical name whose alias list holds it.

    Two columns that would get one name are an error: neither is dropped silently.
    """
    canonical = {alias: name for name, group in (aliases or {}).items() for alias in [name, *group]}
    taken: set[str] = set()
    cols = []
    for c in df.columns:
        slug = header_slug(c)
        name = canonical.get(slug, slug)
        if name in taken:
            raise ValueError(f"two columns would be named {name!r}: {df.columns}")
        taken.add(name)
        cols.append(F.col(f"`{c}`").alias(name))
    return df.select(*cols)


def pack_size(name) -> Column:
    return _pack(name, 1, number=True)


def pack_unit(name) -> Column:
    raw = _pack(name, 2, number=False)
    return (
        F.when(raw == "ml", "ml")
        .when(raw.isin("g", "gr", "gramos"), "g")
        .when(raw.startswith("caps"), "capsulas")
        .when(raw.isin("uds", "unidades"), "uds")
    )


def _pack(name, group: int, number: bool) -> Column:
    text = strip_accents(F.lower(_col(name)))
    amount = r"(\d+(?:[.,]\d+)?)\s*"
    multiplied = F.nullif(F.regexp_extract(text, r"x\s*" + amount + UNIT_WORDS, group), F.lit(""))
    plain = F.nullif(F.regexp_extract(text, amount + UNIT_WORDS, group), F.lit(""))
    found = F.coalesce(multiplied, plain)
    return F.replace(found, F.lit(","), F.lit(".")).try_cast("double") if number else found


def unit_conflict(name, category, unit) -> Column:
    """True where the unit cannot be right: a gel in grams, or a unit against the category family."""
    n, c, u = F.lower(_col(name)), F.lower(_col(category)), _col(unit)
    gel = n.rlike(r"\bgel(es)?\b") & (u == "g")
    volume = c.rlike(VOLUME_CATEGORY) & (u != "ml")
    weight = c.rlike(WEIGHT_CATEGORY) & (u != "g")
    return F.coalesce(gel, F.lit(False)) | F.coalesce(volume, F.lit(False)) | F.coalesce(weight, F.lit(False))


def parse_localized_number(c) -> Column:
    """``1.234,56 €`` is 1234.56 and ``1.234`` is 1234: dots are always thousands. Anything else is null."""
    text = F.regexp_replace(_col(c), r"[^0-9,\-]", "")
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def normalize_bool(c) -> Column:
    # Words read as true.
    words = ["true", "verdadero", "sí", "si", "1", "y", "yes"]
    return F.coalesce(F.lower(F.trim(_col(c).cast("string"))).isin(*words), F.lit(False))


def parse_scope_values(c) -> Column:
    """``1|2`` or ``1,2`` as an array of integers; empty text as an empty array."""
    parts = F.filter(F.transform(F.split(_col(c), r"[|,]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.transform(parts, lambda x: x.cast("long")), F.array().cast("array<bigint>"))


def contains_any(query: str, cols: list[str]) -> Column:
    """Case-insensitive "contains" over several columns."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(query.lower())), F.lit(False))
    return hit


def order_id(supplier, stamp: str) -> Column:
    clean = F.regexp_replace(F.coalesce(_col(supplier).cast("string"), F.lit("NA")), r"\W+", "")
    return F.concat(F.lit("PO_"), clean, F.lit("_" + stamp))


def format_units_ceil(c) -> Column:
    """Rounded up, thousands grouped by dots."""
    return F.replace(F.format_number(F.ceil(_col(c)).cast("long"), 0), F.lit(","), F.lit("."))
