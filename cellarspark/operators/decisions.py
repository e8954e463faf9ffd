"""Whether the leader of a request's candidates is the thing asked for: an ordered list of rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: bars of scores and leads ----
SINGLE, UNIQUE_VISUAL, SATURATED = 0.55, 0.65, 0.90
EXCLUSIVE, EXCLUSIVE_LEAD = 0.58, 0.08
OPEN, OPEN_LEAD = 0.75, 0.20
VISUAL_WIN, TIE, WEAK = 0.50, 0.02, 0.45
HOUSE_LEAD, HOUSE_CLEAR, HOUSE_CLEAR_LEAD = 0.03, 0.78, 0.06
SQUASHED = 0.25
NO_WORD, NO_WORD_LEAD = 0.70, 0.04
# ---- end of fixed values ----

#: columns a request needs: method string; top, second, visual, second_visual double (NULL second: no runner-up);
#: exclusive, conflicts, generic, house boolean; size, words int
RULES: tuple[tuple[str, str], ...] = (
    ("method IN ('barcode', 'qr', 'code')", "true"),
    ("conflicts", "false"),
    ("generic", f"NOT exclusive AND NOT weak AND visual >= {OPEN} AND visual_lead >= {OPEN_LEAD}"),
    (f"exclusive AND alone AND NOT house AND (top >= {SINGLE} OR visual >= {UNIQUE_VISUAL})", "true"),
    (f"exclusive AND NOT house AND top >= {EXCLUSIVE} AND lead >= {EXCLUSIVE_LEAD}", "true"),
    (f"house AND visual_lead < {HOUSE_LEAD}", "false"),
    (f"exclusive AND NOT house AND top >= {SATURATED} AND visual_lead > 0 AND visual >= {VISUAL_WIN}", "true"),
    (f"NOT exclusive AND size = 1 AND NOT house AND visual >= {UNIQUE_VISUAL} AND visual_lead >= {TIE}", "true"),
    (f"NOT house AND top < {SQUASHED} AND visual >= {OPEN} AND visual_lead >= {OPEN_LEAD}", "true"),
    (f"house AND visual >= {HOUSE_CLEAR} AND visual_lead >= {HOUSE_CLEAR_LEAD}", "true"),
    ("words = 0", f"NOT weak AND visual >= {NO_WORD} AND visual_lead >= {NO_WORD_LEAD}"),
    (f"exclusive AND NOT house AND top >= {EXCLUSIVE} AND visual_lead >= -{TIE} AND visual_lead < 0", "true"),
    (f"visual_lead < -{TIE}", "false"),
    ("visual_lead < 0 AND words <= 0", "false"),
    (f"visual_lead = 0 AND lead < {EXCLUSIVE_LEAD}", "false"),
    (f"exclusive AND top >= {EXCLUSIVE} AND lead >= {EXCLUSIVE_LEAD}", "true"),
    (f"top >= {OPEN} AND lead >= {OPEN_LEAD}", "true"),
)
#: what the rules read beside the columns; a request without runner-up leads by 1
LEADS = {
    "lead": "CASE WHEN second IS NULL THEN 1.0D ELSE top - second END",
    "alone": "second IS NULL OR size <= 1",
    "visual_lead": "CASE WHEN second_visual IS NULL THEN 1.0D ELSE visual - second_visual END",
    "weak": f"visual < {WEAK} AND (second_visual IS NULL OR second_visual < {WEAK})",
}


def with_leads(df):  # noqa: ANN001, ANN201
    """The requests with what the rules read."""
    return df.withColumns({k: F.expr(v) for k, v in LEADS.items()})


def rule() -> Column:
    """The number of the first rule that fits, from 1; one more than their number if none does."""
    out = F
    for k, (when, _) in enumerate(RULES, 1):
        out = out.when(F.expr(when), k)
    return out.otherwise(len(RULES) + 1)


def accepted() -> Column:
    """The verdict of the first rule that fits; false if none does."""
    out = F
    for when, verdict in RULES:
        out = out.when(F.expr(when), F.expr(verdict))
    return out.otherwise(F.lit(False))


def sql_case(values: bool) -> str:
    """The rules as SQL: their verdicts, or their numbers."""
    arms = " ".join(f"WHEN {w} THEN {v if values else k}" for k, (w, v) in enumerate(RULES, 1))
    return f"CASE {arms} ELSE {'false' if values else len(RULES) + 1} END"
