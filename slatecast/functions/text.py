"""Repair of recognised labels, and how alike two texts are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as text tools see it: Unicode's, and the four ASCII separators.
_BLANK = r"[\s\x1c-\x1f]"


#: The same characters one by one.
_BLANKS = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(text: Column) -> Column:
    """Without white space at both ends, ideographic and no-break spaces included; most texts have none and need no pattern."""
    at_end = F.substring(text, 1, 1).isin(*_BLANKS) | F.substring(text, -1, 1).isin(*_BLANKS)
    return F.when(at_end, F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")).otherwise(text)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used; a plain column would be written out each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@dataclass(frozen=True)
class Repair:
    """How labels of one type are repaired: replacements in order, then a prefix that every label gets."""

    prefix: str
    replacements: tuple[tuple[str, str], ...]
    bare: str | None  # a label that starts so, without the colon, has ``skip`` characters put off for the prefix
    skip: int
    head: int  # the first so many characters, blanks taken out,
    misread: tuple[str, ...]  # are one of these: the label follows its colon or semicolon, or else those characters


def _all_to(target: str, words: str) -> tuple[tuple[str, str], ...]:
    return tuple((w, target) for w in words.split())


#: What recognition makes of the two prefixes. Their order matters, as each looks at what the ones before left.
VFX = Repair("VFX:", (*_all_to("VFX:", "VEX: VFX; VEX; VFX. VEX. FX:"), ("VVFX:", "VFX:")), "VFX", 3, 4, ("vfx", "vex", "vpx", "vix"))
DI = Repair("DI:", _all_to("DI:", "D1: D1; Di Di; Di: Dl: D|: DL: 01: DI; D1; Dl; D|; DL; 01;"), "DI", 3, 3, ("di", "d1", "dl", "ol", "oi", "01"))
LEGACY_VFX = Repair("VFX:", _all_to("VFX:", "VEX: VFX; VEX;"), None, 0, 4, VFX.misread)
LEGACY_DI = Repair("DI:", _all_to("DI:", "D1: Dl: D|: DL: 01: DI; D1; Dl; D|; DL; 01;"), None, 0, 3, DI.misread)


def _replaced(text: Column, rule: Repair) -> Column:
    for old, new in rule.replacements:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _prefixed(out: Column, rule: Repair) -> Column:
    """A label whose replacements are made, with the prefix of its type."""
    colon, semicolon = F.instr(out, ":"), F.instr(out, ";")
    behind = (
        F.when(colon > 0, F.substring(out, colon + 1, F.length(out)))
        .when(semicolon > 0, F.substring(out, semicolon + 1, F.length(out)))
        .otherwise(F.substring(out, F.lit(rule.head + 1), F.length(out)))
    )
    start = F.lower(F.replace(F.substring(out, 1, rule.head), F.lit(" "), F.lit("")))
    prefix = F.lit(rule.prefix)
    made = F.when(out.startswith(rule.prefix), out)
    if rule.bare is not None:
        made = made.when(out.startswith(rule.bare), F.concat(prefix, F.substring(out, F.lit(rule.skip + 1), F.length(out))))
    return made.when(start.isin(*rule.misread), F.concat(prefix, behind)).otherwise(F.concat(prefix, out))


def repaired(text: Column, rule: Repair) -> Column:
    """The label in its usual form; empty stays empty."""
    return F.when(text == "", text).otherwise(bound(_replaced(text, rule), lambda out: _prefixed(out, rule)))


def normalized(text: Column, text_type: Column, legacy: bool = False) -> Column:
    """Labels of type VFX by one rule set, all others by the other."""
    vfx, di = (LEGACY_VFX, LEGACY_DI) if legacy else (VFX, DI)
    is_vfx = F.coalesce(text_type == "VFX", F.lit(False))
    replaced = F.when(is_vfx, _replaced(text, vfx)).otherwise(_replaced(text, di))
    made = bound(replaced, lambda out: F.when(is_vfx, _prefixed(out, vfx)).otherwise(_prefixed(out, di)))
    return F.when(text == "", text).otherwise(made)


def letters(text: Column) -> Column:
    """The set of a text's lower-cased code points."""
    return F.when((text == "") | text.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(F.lower(text), "")))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard likeness of the two sets of letters; 0 if either is empty."""
    def of(sets: Column) -> Column:
        x, y = F.size(sets["x"]), F.size(sets["y"])
        both = F.size(F.array_intersect(sets["x"], sets["y"]))
        return F.when((x == 0) | (y == 0), F.lit(0.0)).otherwise(both / (x + y - both))

    return bound(F.struct(letters(a).alias("x"), letters(b).alias("y")), of)


def base_name(path: Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_extract(path, r"([^/\\]*?)(\.[^./\\]*)?$", 1)
