"""Named queries of item labels, tag forms, list and question stages and citation forms, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks
from ..operators import stages
from .catalogue import DOC, POS, events, query
from .catalogue_review import _chosen, _pick

_LABELS = ["Fig. 3–2a", "TABLE 4.1", "Box 7", "exhibit 2--3", "Appendix B", "Case Study 9", "see Fig 12 and Table 3", "References:", "<H1>Further Reading", "", "[5]"]
_HEADINGS = ", ".join(repr(h) for h in checks.REFERENCE_HEADINGS)


_FORMS = ["TXT/H1", "BL_MID", "BL-MID, TXT", "odd|H2", "REF-N", "H1", "T2", "X+Y", "TXT", "X-Y"]
_KNOWN = ["TXT", "H1", "H2", "T2", "BL-MID"]
_ALIASES = {"BL-MID": "BL-FIRST", "X_Y": "H3", "T2": "T3"}


def _aliased(tag: str) -> str:
    return f"CASE {tag} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ALIASES.items()) + " END"


_LISTED = ["BL-FIRST", "NL2-MID", "TXT", "KT-BL2-LAST", "UL-MID", "BL4-LAST", "H1"]
_LIST_ZONES = ["BODY", "TABLE", "REFERENCE", "BOX_BX1", "BODY"]
_PREFIXES = ["", "EOC-NL-", "KT-BL-"]


_ASKED = ["1. What is it?", "Q2. Why?", "(3) Name", "4) List", "Plain words", "x. no"]
_ASKED_TAGS = ["TXT", "REF-N", "QQ", "NL-MID", "H1"]
_ASKED_ZONES = ["BODY", "EXERCISE", "BACK_MATTER", "BODY", "BODY"]
_QUESTION = "(starts_with({0}, 'QUES-') OR starts_with({0}, 'REV-QUES-') OR starts_with({0}, 'EXER-') OR starts_with({0}, 'CS-QUES-') OR starts_with({0}, 'BX1-QUES-'))"


_CITED = ["(Smith et al 2001)", "(Smith 1999a)", "(Smith & Jones 2004)", "Lee et al. (2010)", "(Brown, nd)", "(Brown n.d.)", "(Green In Press)", "none", ""]
_LOCATORS = ["p. 3", "pp. 3–5", "p. 3-5", "pp. 7", "p.9", "pp.1-2", "P. 4"]
_NAMED = "[A-Z][\\w''’-]+"
_PAIR = f"({_NAMED}(?:\\s+(?:&|and)\\s+{_NAMED})?)"
