"""String and label-set expressions (cleaning, normalising, shortening)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label_set_split(c: Column | str, sep: str = ";") -> Column:
    """NULL or '' -> empty array; else distinct items of split on ``sep``."""
    s = _c(c)
    return (F.when(s.isNull() | (s == ""), F.array().cast("array<string>"))
            .otherwise(F.array_distinct(F.split(s, "\\" + sep if sep in "|.^$*+?()[]{}\\" else sep))))


def clean_label_set(c: Column | str) -> Column:
    """Free-text label cell -> sorted distinct cleaned items.

    NULL -> empty.  A Python-list literal like "['a', 'b']" yields its quoted
    items; anything else is split on ';' or '|'.  Items are trimmed and
    lower-cased; '', 'nan' and 'none' are dropped.
    """
    s = F.trim(_c(c))
    is_list = s.startswith("[") & s.endswith("]")
    quoted = F.regexp_extract_all(s, F.lit("'([^']*)'|\"([^\"]*)\""), 0)
    unquoted = F.transform(quoted, lambda x: F.regexp_replace(x, "^['\"]|['\"]$", ""))
    parts = F.when(is_list, unquoted).otherwise(F.split(s, "[;|]"))
    # the drop test looks at the trimmed item before case folding
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: ~x.isin("", "nan", "None"))
    items = F.transform(kept, lambda x: F.lower(x))
    return F.when(s.isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(items)))


def normalize_compound(c: Column | str) -> Column:
    return F.lower(F.trim(_c(c)))


def normalize_gene(c: Column | str) -> Column:
    return F.upper(F.trim(_c(c)))


# Ordered literal replacements used to shorten long labels for
# display; they must equal the reference's list and are applied in this order.
LABEL_REPLACEMENTS = [
    ("inhibitor", "inh."),
    ("agonist", "ago."),
    ("antagonist", "antag."),
    ("receptor", "rec."),
    ("modulator", "mod."),
    ("sensitizer", "sens."),
    ("Tyrosine kinase", "TK"),
    ("Protein synthesis", "Prot. synth."),
    ("Estrogen", "ER"),
    ("Dopamine", "DA"),
    ("Glucocorticoid", "GC"),
    ("Insulin", "Ins."),
]


def shorten_label(c: Column | str, replacements=None) -> Column:
    out = _c(c)
    for old, new in (replacements or LABEL_REPLACEMENTS):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, "\\s+", " "))
