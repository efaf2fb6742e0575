"""Name clean-up, aliases, and group inference as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinweave import vocab
from kinweave.functions.rules import first_contained, first_matching

# --- fixed values: characters dropped from names, and spelling variants folded together ----------
SEPARATORS = " 　·・.。'\"''\"·-‐–—_/／（）()〔〕[]"
SPELLING_VARIANTS: dict[str, str] = {
    "恺": "凯", "蒂": "提", "佛": "弗", "茨": "兹", "莎": "沙",
    "娅": "亚", "锹": "乔",
    "ō": "o", "ū": "u", "ā": "a", "ē": "e", "ī": "i",
    "ö": "o", "ü": "u", "é": "e", "á": "a",
}
# Characters that their compatibility form leaves as they are, alone and next to each other.
STABLE = (r"\x00-\x7F", "·", "À-ı", "一-鿿", "ぁ-ゖ", "ァ-ヺ", "、。〔〕「」")
# One class for each kind, and no way back: a class of several ranges costs twenty times as much for each character.
ALL_STABLE = rf"\A(?:{'|'.join(f'[{kind}]++' for kind in STABLE)})*+\z"
BRACKETED = r"[（(][^）)]*[）)]"
CLASS_SUFFIX = (
    r"(?i)\s*·\s*(Saber|Archer|Lancer|Rider|Caster|Assassin|Berserker|Ruler|Avenger|"
    r"MoonCancer|Foreigner|Pretender|Alter\s*Ego|Shielder|Beast)\s*$"
)


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda value: unicodedata.normalize("NFKC", value), na_action="ignore")


def compatibility_form(text: Column) -> Column:
    """NFKC form. Spark has no such function; text that it cannot change is not handed to Python."""
    foreign = F.when(~text.rlike(ALL_STABLE), text)
    return F.coalesce(_nfkc(foreign), text)


def normalize_name(text: Column, folding: Mapping[str, str] | None = None) -> Column:
    """Key under which two spellings of a name count as one.

    ``folding`` maps single characters, for instance traditional to simplified forms.
    """
    plain = F.lower(F.translate(compatibility_form(F.coalesce(text, F.lit(""))), SEPARATORS, ""))
    folds = {**SPELLING_VARIANTS, **(folding or {})}
    return F.translate(plain, "".join(folds), "".join(folds.values()))


def bracket_case_form(text: Column) -> Column:
    """Weaker key used for guesses: half-width brackets, trimmed, lower case."""
    return F.lower(F.translate(F.trim(text), "（）〔〕［］", "()()[]"))


def strip_brackets(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BRACKETED, ""))


def guess_prototype(name: Column) -> Column:
    """The bare name: no bracketed part, no class suffix."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, BRACKETED, ""), CLASS_SUFFIX, ""))


def has_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[぀-ヿ一-鿿]"), F.lit(False))


def normalize_region(raw: Column) -> Column:
    """Full region name of the first contained keyword; blank markers become empty text."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    blank = (text == "") | text.isin(*vocab.REGION_BLANKS)
    return F.when(blank, F.lit("")).otherwise(F.coalesce(first_contained(text, vocab.REGION_KEYWORDS), text))


def infer_mythology(prototype: Column, name: Column, region: Column) -> Column:
    """Region first, then keywords in the prototype, then keywords in the name, else empty text."""
    known = normalize_region(region)
    found = [F.when(known.isin(*vocab.MYTHOLOGIES), known)]
    for text in (prototype, name):
        found += [first_contained(text, vocab.PROTOTYPE_KEYWORDS), first_contained(text, vocab.REGION_KEYWORDS)]
    return F.coalesce(*found, F.lit(""))


def build_aliases(name: Column, prototype: Column, extras: Column | None = None) -> Column:
    """Name, name without brackets, prototype, extras: trimmed, not empty, in order, once each."""
    forms = F.array(name, strip_brackets(name), prototype)
    if extras is not None:
        forms = F.concat(forms, F.coalesce(extras, F.array().cast("array<string>")))
    forms = F.transform(forms, lambda form: F.trim(F.coalesce(form, F.lit(""))))
    return F.array_distinct(F.filter(forms, lambda form: form != ""))


def name_variants(native: Column, full: Column, alternatives: Column, limit: int = 6) -> Column:
    """Up to ``limit`` (name, lang) pairs, native name first.

    The name key needs a Python step that cannot run inside an array lambda, so spellings are told
    apart by the Catalyst part of the key: separators, case and variants.
    """
    def variant(text: Column, lang: Column) -> Column:
        return F.struct(F.trim(text).alias("name"), lang.alias("lang"))

    others = F.transform(
        F.coalesce(alternatives, F.array().cast("array<string>")),
        lambda alt: variant(alt, F.when(has_cjk(alt), F.lit("ja")).otherwise(F.lit("en"))),
    )
    others = F.filter(others, lambda v: F.length(v["name"]) >= 2)
    listed = F.concat(F.array(variant(native, F.lit("ja")), variant(full, F.lit("en"))), others)
    folds = SPELLING_VARIANTS
    keyed = F.transform(
        listed,
        lambda v: F.struct(
            F.translate(F.lower(F.translate(v["name"], SEPARATORS, "")), "".join(folds), "".join(folds.values()))
            .alias("key"),
            v["name"].alias("name"),
            v["lang"].alias("lang"),
        ),
    )
    keyed = F.filter(keyed, lambda v: F.coalesce(v["key"], F.lit("")) != "")
    keys = F.transform(keyed, lambda v: v["key"])
    firsts = F.filter(keyed, lambda v, i: F.array_position(keys, v["key"]) == i + 1)
    return F.slice(F.transform(firsts, lambda v: F.struct(v["name"], v["lang"])), 1, limit)


def work_kind(class_text: Column) -> Column:
    """Kind of a work from its class text; the first pattern that matches decides."""
    return first_matching(F.lower(class_text), vocab.WORK_KINDS, "other")


def medium_of(class_text: Column, label: Column) -> Column:
    animated = class_text.rlike(vocab.MEDIA_CLASS) | has_cjk(label)
    return F.when(animated, F.lit("acg")).otherwise(F.lit("other-media"))


def character_or_work(class_text: Column) -> Column:
    """'character', 'work' or NULL; a class text that fits both is a character."""
    return (
        F.when(class_text.rlike(vocab.CHARACTER_CLASS), F.lit("character"))
        .when(class_text.rlike(vocab.WORK_CLASS), F.lit("work"))
    )


