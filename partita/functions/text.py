"""Scalar expressions over sequences, formulas, annotations and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partita.functions.hashing import blake2b_hex1

# Metal words of annotations and their symbols.
METAL_WORDS = {
    "nickel": "NI", "cobalt": "CO", "zinc": "ZN", "iron": "FE", "ferrous": "FE", "ferric": "FE", "magnesium": "MG", "manganese": "MN", "calcium": "CA",
    "copper": "CU", "cadmium": "CD", "molybdenum": "MO", "tungsten": "W", "mercury": "HG", "mercuric": "HG", "platinum": "PT", "thallium": "TL",
    "osmium": "OS", "iridium": "IR", "lanthanum": "LA", "cerium": "CE", "praseodymium": "PR", "neodymium": "ND", "samarium": "SM", "europium": "EU",
    "gadolinium": "GD", "terbium": "TB", "dysprosium": "DY", "holmium": "HO", "erbium": "ER", "thulium": "TM", "ytterbium": "YB", "lutetium": "LU",
}
GENERIC_METAL = "METAL"


def formula_elements(formula: Column) -> Column:
    """Distinct upper-case element symbols of a formula, sorted; charges and counts don't matter."""
    bare = F.regexp_replace(F.coalesce(formula, F.lit("")), "[0-9]+[+-]?", " ")
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit("([A-Z][a-z]?)"), F.lit(1)), F.upper)))


def longest_run(seq: Column, residue: str) -> Column:
    """Length of the longest run of one letter, in either case."""
    runs = F.regexp_extract_all(F.upper(F.coalesce(seq, F.lit(""))), F.lit(f"({residue.upper()}+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def terminal_run(seq: Column, residue: str, window: int = 20) -> Column:
    """The longest run inside the first or last ``window`` letters."""
    return F.greatest(longest_run(F.substring(seq, 1, window), residue), longest_run(F.right(seq, F.lit(window)), residue))


def has_tag(seq: Column, min_run: int, terminal_min_run: int, residue: str = "H") -> Column:
    out = longest_run(seq, residue) >= min_run
    return out | (terminal_run(seq, residue) >= terminal_min_run) if terminal_min_run > 0 else out


def metal_symbols(annotation: Column) -> Column:
    """Symbols of the metals an annotation names in whole words; else the generic one if it says metal at all."""
    low = F.lower(F.coalesce(annotation, F.lit("")))
    words = F.array_distinct(F.regexp_extract_all(low, F.lit("([a-z]+)"), F.lit(1)))
    names = F.create_map(*[F.lit(x) for pair in METAL_WORDS.items() for x in pair])
    named = F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda w: w.isin(list(METAL_WORDS))), lambda w: F.element_at(names, w))))
    generic = F.when(low.contains("metal"), F.array(F.lit(GENERIC_METAL))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(named) > 0, named).otherwise(generic)


def is_saccharide(comp_type: Column) -> Column:
    return F.coalesce(F.lower(comp_type).contains("saccharide"), F.lit(False))


def without_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def modeled_length(seq: Column, both_cases: bool) -> Column:
    """Letters whose identity is known: the filter ignores ``X`` and ``x``, the clustering ``X`` only."""
    return F.length(F.regexp_replace(F.coalesce(seq, F.lit("")), "[Xx]" if both_cases else "X", ""))


def entry_of_chain(chain: Column) -> Column:
    """What stands before the last underscore."""
    return F.regexp_replace(chain, "_[^_]*$", "")


def run_spans(seq: Column, residue: str = "H", min_run: int = 4, window: int = 20) -> Column:
    """1-based ``(start, stop)`` of runs that reach into either end of a sequence, if an end holds a long enough run by itself."""
    text = F.upper(F.coalesce(seq, F.lit("")))
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    starts = F.filter(places, lambda k: (F.substring(text, k, F.lit(1)) == residue.upper()) & ((k == 1) | (F.substring(text, k - 1, F.lit(1)) != residue.upper())))
    spans = F.transform(starts, lambda k: F.struct(k.alias("start"), (k - 1 + F.length(F.regexp_extract(F.substring(text, k, F.length(text)), f"^({residue.upper()}+)", 1))).alias("stop")))
    held = F.filter(spans, lambda s: (s["stop"] - s["start"] + 1 >= min_run) & ((s["start"] <= window) | (s["stop"] > F.length(text) - window)))
    return F.when(terminal_run(text, residue, window) >= min_run, held).otherwise(F.slice(spans, 1, 0))


def release_date(stamp: Column) -> Column:
    return F.coalesce(F.left(stamp, F.lit(10)), F.lit(""))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def core_id(entry_id: Column) -> Column:
    """A lower-case identifier without its archive prefix."""
    # The prefixes.
    low = F.lower(entry_id)
    return F.when(low.rlike("^pdb_0000."), F.substring(low, 9, 1000)).when(low.startswith("pdb_"), F.substring(low, 5, 1000)).otherwise(low)


def file_name(entry_id: Column, assembly: bool) -> Column:
    return F.concat(core_id(entry_id), F.lit("-assembly1.cif.gz" if assembly else ".cif.gz"))


def relative_path(entry_id: Column, split: Column, assembly: bool) -> Column:
    """``structures/<split>/<shard>/<file>``; the shard is the second and third letter, or a hash of a shorter core."""
    core = core_id(entry_id)
    shard = F.when(F.length(core) >= 3, F.substring(core, 2, 2)).otherwise(blake2b_hex1(F.when(F.length(core) < 3, core)))
    return F.concat_ws("/", F.lit("structures"), split, shard, file_name(entry_id, assembly))
