"""Label functions over composite unit names.

Units carry their metadata in the name, e.g. human
``cluster_response_timepoint_ident_patient_count`` and mouse
``celltype_sample_count``. These builders return Columns, so they stay inside
whole-stage codegen; reports evaluate them on unit-level rows after filtering.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Human cell-type rules, first match wins, tested as substrings of
# the whole unit name. The violin reports use "Antigen" as the first pattern,
# the ranking, heatmap and correlation reports "AntigenPresentation".
HUMAN_CELL_TYPE_RULES = [
    ("AntigenPresentation", "Antigen Presentation"),
    ("Interferon", "Interferon Alpha Beta Response"),
    ("Melanocytic", "Melanocytic"),
    ("Mesenchymallike", "Mesenchymal like"),
    ("Mitochondrial", "Mitochondrial low quality"),
    ("Mitotic", "Mitotic"),
    ("NeuralCrestlike", "Neural Crest like"),
    ("PatientspecificA", "Patient specific A"),
    ("PatientspecificB", "Patient specific B"),
    ("Hypoxia", "Stress Hypoxia Response"),
    ("p53", "Stress p53 Response"),
]
HUMAN_CELL_TYPE_RULES_VIOLIN = [("Antigen", "Antigen Presentation")] + HUMAN_CELL_TYPE_RULES[1:]

# Mouse cell-type rules, first match wins.
MOUSE_CELL_TYPE_RULES = [
    ("B-cell", "B-cell"),
    ("CAF", "CAF"),
    ("DC", "DC"),
    ("EC", "EC"),
    ("Malignant", "Malignant"),
    ("Monocyte", "Monocyte/macrophage"),
    ("Pericyte", "Pericyte"),
    ("NKcell", "T/NKcell"),
]

# Timepoint and response rules, first match wins.
TIMEPOINT_RULES = [("BT", "BT"), ("OT", "OT")]
RESPONSE_RULES = [("_NonResponders", "Non Responders"), ("_Responders", "Responders")]

# Cluster-name rewrites applied, in this order, before the
# composite key is built, so that "_" only separates key fields.
CLUSTER_REWRITES = [
    ("Antigen_Presentation", "AntigenPresentation"),
    ("Interferon_Alpha_Beta_Response", "InterferonAlphaBetaResponse"),
    ("Mesenchymal_like", "Mesenchymallike"),
    ("Mitochondrial(low_quality)", "Mitochondriallowquality"),
    ("Neural_Crest_like", "NeuralCrestlike"),
    ("Patient_specific_", "Patientspecific"),
    ("Stress(HypoxiaResponse)", "StressHypoxiaResponse"),
    ("Stress(p53Response)", "Stressp53Response"),
]

# Regexes of the two name-trimming steps.
TRAILING_TOKEN = "_[^_]+$"      # L1: drop the last "_token"
LEADING_TOKEN = "^[^_]*."       # L2: drop the first token and one more character


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_last_token(c: str | Column, times: int = 1) -> Column:
    """L1 applied ``times`` times."""
    out = col_(c)
    for _ in range(times):
        out = F.regexp_replace(out, TRAILING_TOKEN, "")
    return out


def strip_first_token(c: str | Column, times: int = 1) -> Column:
    """L2 applied ``times`` times."""
    out = col_(c)
    for _ in range(times):
        out = F.regexp_replace(out, LEADING_TOKEN, "")
    return out


def sample_of(c: str | Column, n_lead: int, n_trail: int) -> Column:
    """L3: ``n_trail`` x L1, then ``n_lead`` x L2."""
    return strip_first_token(strip_last_token(c, n_trail), n_lead)


def first_match(c: str | Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered substring rules; NULL when nothing matches."""
    c = col_(c)
    out = None
    for pattern, label in rules:
        cond = c.contains(pattern)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def timepoint_of(c: str | Column) -> Column:
    return first_match(c, TIMEPOINT_RULES)


def response_of(c: str | Column) -> Column:
    return first_match(c, RESPONSE_RULES)


def human_cell_type(c: str | Column, violin: bool = False) -> Column:
    return first_match(c, HUMAN_CELL_TYPE_RULES_VIOLIN if violin else HUMAN_CELL_TYPE_RULES)


def mouse_cell_type(c: str | Column) -> Column:
    return first_match(c, MOUSE_CELL_TYPE_RULES)


def normalise_cluster(c: str | Column) -> Column:
    """Literal rewrites, every occurrence, in table order."""
    out = col_(c)
    for search, repl in CLUSTER_REWRITES:
        out = F.replace(out, F.lit(search), F.lit(repl))
    return out


def remove_spaces(c: str | Column) -> Column:
    """L4."""
    return F.regexp_replace(col_(c), " ", "")


def na_text(c: str | Column) -> Column:
    """Render NULL as the text NA, as R's paste0 does (Q3)."""
    return F.coalesce(col_(c).cast("string"), F.lit("NA"))


def composite_key(parts: Sequence[str | Column], sep: str = "_") -> Column:
    """Join fields with ``sep``, NULL fields as NA (not skipped, not NULL)."""
    pieces: list[Column] = []
    for i, p in enumerate(parts):
        if i:
            pieces.append(F.lit(sep))
        pieces.append(na_text(p))
    return F.concat(*pieces)


def prefixed(c: str | Column, prefix: str) -> Column:
    """P10: e.g. cluster_<n>."""
    return F.concat(F.lit(prefix), na_text(c))


def sample_cell_type(c: str | Column) -> Column:
    """Unit name less its last two tokens."""
    return strip_last_token(c, 2)


def log_or_zero(c: str | Column) -> Column:
    """L10 + L11: natural log, with log(0) = -Inf, NaN, Inf and NULL all mapped to 0."""
    x = col_(c)
    bad = x.isNull() | F.isnan(x) | (x <= 0) | (x == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(F.ln(x))



def has_no_dot_or_dash(c: str | Column) -> Column:
    """F4 predicate: keep genes without '.' and without '-'."""
    g = col_(c)
    return ~g.contains(".") & ~g.contains("-")


def not_matching(c: str | Column, pattern: str) -> Column:
    """!grepl(pattern, x), which is TRUE for NULL x (Q4)."""
    return ~F.coalesce(col_(c).contains(pattern), F.lit(False))


def contains_ci(c: str | Column, token: str) -> Column:
    """Case-insensitive substring test, like tidyselect contains()."""
    return F.lower(col_(c)).contains(token.lower())


def first_appearance_order(df: DataFrame, label: str, position: str) -> DataFrame:
    """Add ``<label>_ord``, the order in which each label first appears by ``position``.

    A NULL label is not a factor level; it is drawn last, so it takes the last
    rank. The label set is bounded by a rule table, so the window over it is tiny.
    """
    from pyspark.sql import Window

    from setscore.operators.joins import join_on_keys
    firsts = df.groupBy(label).agg(F.min(position).alias("_first"))
    order = Window.orderBy(F.col(label).isNull(), F.col("_first"))
    ordered = firsts.select(label, F.dense_rank().over(order).cast("long").alias(f"{label}_ord"))
    return join_on_keys(df, ordered, [label], "left")


def human_unit_labels(units: DataFrame, unit_col: str = "unit", n_lead: int = 3, n_trail: int = 2,
                      violin: bool = False) -> DataFrame:
    """L3, L5-L7 over a frame of distinct units."""
    u = F.col(unit_col)
    return units.select(unit_col,
                        sample_of(u, n_lead, n_trail).alias("sample"),
                        response_of(u).alias("response"),
                        timepoint_of(u).alias("timepoint"),
                        human_cell_type(u, violin).alias("cell_type"))


def mouse_unit_labels(units: DataFrame, unit_col: str = "unit") -> DataFrame:
    """L3 (1 lead, 1 trail) and L8 over a frame of distinct units."""
    u = F.col(unit_col)
    return units.select(unit_col, sample_of(u, 1, 1).alias("sample"), mouse_cell_type(u).alias("cell_type"))
