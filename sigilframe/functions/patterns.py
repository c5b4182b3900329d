"""Vocabulary of the definition classifier.

The strings below are fixed values: results depend on every one of them.  They are written so that
Python's ``re`` and Java's ``java.util.regex`` read them alike; Columns prefix ``(?iU)``.
"""

from __future__ import annotations

# Character and font classes.
MATH_CHARS = "=~+-*/^_<>|∈∉∑√∞±≤≥∂∇∫∏∝≈≠×·∗∀∃∅∪∩⊂⊆⊥→←↔⇒⇔αβγδεζηθικλμνξοπρστυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"
MATH_FONT = r"^(?:CMMI|CMMIB|MSBM|MSAM|CMSY|CMEX|MTMI|MTSYN|MTEX|MTSY|MT2(?:MI|SY|EX|HR|MIF|MIT|MIS)|Realpage(?:MTIM|TEC|MTEX|SYM|ALL)|STIXMath|MathTime|TeX|Symbol|Euclid|txmi|pxmi)"
BOLD_MATH_FONT = r"^(?:CMBX|CMMIB|CMBSY|RMTMIB|MSBM|STIXMath(?:-Bold)?|MM(?:Greek|Times|Relation|Binary|Etc|aFermat)-?Bold)"
ITALIC_FONT = r"italic|ital|oblique|math|mtmi|cmmi|stix"
STRUCTURAL_FONT = r"^(?:CMEX|CMSY|MSAM|MSBM|LMMathSymbols|LMMathExtension)"
SUBSET_PREFIX = r"^[A-Z]{6}\+"

# Font styles in order of precedence, matched on the upper-case family.
FONT_STYLES = (
    ("blackboard", r"MSBM|DOUBLE.?STRUCK|BLACKBOARD|BBM"),
    ("fraktur", r"FRAKTUR|EUFM|EUSM|UNIFRAKTUR"),
    ("script", r"SCRIPT|RSFS|CALIGRAPH|CAL"),
    ("bold", r"CMMIB|CMBX|BOLD"),
    ("italic", r"CMMI|CMTI|ITALIC|OBLIQUE"),
    ("roman", r"CMR|TIMES.?ROMAN|ROMAN|REGULAR"),
)

# Wording of definitions.
_L = "A-Za-zΑ-Ωα-ω"
_SUBJECT = rf"(?:[{_L}]\b|[{_L}]\s*[\(\[\{{])"
_LIST = rf"[{_L}](?:\s*(?:[,;/]|and)\s*[{_L}])*"
CHINESE = r"其中|式中|表示|定义(?:为|是)?|记为|记作|记|设|令|取|分别为|对应于|指的是|称为"
LET = (
    rf"\blet\s+(?!us\b)(?:the\s+[{_L}][{_L}-]{{0,24}}\s+)?{_LIST}\s*"
    r"(?:=|:=|\bbe\b|\bdenot(?:e|es|ed)\b|\brepresent(?:s)?\b|\bstand\s+for\b|\bhave\b|\bconsist(?:s)?\b|∈|:|\b[RCNMXY]\b)"
)
WHERE_SUBJECT = rf"\bwhere\s+{_SUBJECT}"
WHERE_VERB = r"\bwhere\s+(?:and\s+)?(?:represent(?:s|ed)?|denote(?:s|d)?)\b"
DEFINE_VERB = r"\b(?:denote|denotes|denoted|define|defines|defined)\b"
GIVEN_ARTICLE = r"\bgiven\s+(?:a|an|the)\b"
GIVEN_CAPITAL = r"\bgiven\s+[A-ZΑ-Ω]\b"  # here case matters
ROLE_NOUN = (
    r"\b(?:matrix|matrices|vector|vectors|function|functions|operator|parameter|parameters|constant|constants|variable|variables|"
    r"steps?|coefficient|coefficients|dimension|dimensions|random variable|set|sets|map|mapping|distribution|penalty|penalties|term|terms)"
    rf"\s+{_LIST}\b(?:\s*(?:[=∈⊂:;,]|is\b|are\b|can\b|will\b|denotes?\b|represents?\b))"
)
ADJECTIVE = (
    rf"\b[{_L}]\b\s+(?:is|are)\s+(?:sparse|atomic|non[- ]?negative|positive|negative|real|complex|orthogonal|independent|identical|"
    r"differentiable|convex|concave|normalized|normalised|bounded|continuous|uniformly convex|identity|nonzero|zero|finite|infinite)\b"
)
COPULA = rf"(?:\b[{_L}]\b|\([^)]{{1,24}}\))\s+(?:is|are|represents?|corresponds?|refers?)\s+(?:a|an|the|used|chosen|defined|called|our)\b"
DEFINITION = (
    r"\bdefinition\s+\d+\b",
    CHINESE,
    WHERE_SUBJECT,
    LET,
    DEFINE_VERB,
    rf"\bwe\s+use\s+{_SUBJECT}",
    GIVEN_ARTICLE,
    r"\bwhere\s+we\s+(?:observe|consider|have|use|denote|define|assume)\b",
    rf"\bwe\s+say\s+that\s+{_SUBJECT}\s+(?:is|are)\b",
    ROLE_NOUN,
    ADJECTIVE,
    r"\brefer\s+to\s+(?:it|this|these|them)\s+as\b",
    COPULA,
)
FORMULA_SIGNAL = (WHERE_SUBJECT, WHERE_VERB, LET, DEFINE_VERB, r"\brefer\s+to\s+it\s+as\b", CHINESE, GIVEN_ARTICLE)
TRIGGER = (
    r"\b(?:where|let|denote(?:d|s)?(?:\s+by)?|define[sd]?|defined\s+as|we\s+use|given|refer\s+to\s+it\s+as|definition\s+\d+)\b|"
    rf"(?:{CHINESE})"
)
GENERIC_DEFINITION = r"\bdefine\s+(?:the\s+)?(?:cost|objective|loss|utility)\s+function"
REFERENCES_HEADING = r"^(?:references|bibliography|参考文献)\b"
RELATION = r"\b(?:where|here|let|given)\b|(?:其中|式中|表示|定义|记为|设|令)"

# Words beside a plain-font letter that make it a symbol.
RIGHT_WORDS = {
    "is", "are", "denotes", "denote", "represents", "represent", "means", "mean", "matrix", "vector", "function", "set", "number", "dimension",
    "dimensional", "parameter", "variable", "index", "coefficient", "coefficients", "column", "row",
}
LEFT_WORDS = {
    "where", "let", "denote", "by", "as", "and", "or", "x", "×", "atom", "atoms", "matrix", "matrices", "vector", "vectors", "set", "function",
    "operator", "parameter", "variable", "dictionary", "group", "groups", "space", "spaces", "source", "sources",
}
ARTICLE_VERBS = {"is", "are", "means", "denotes", "denote", "represents", "represent", "called"}
NEIGHBOUR_OPERATORS = "=~≈×+/()[]{}∈∑∫|"
SHORT_LINE_OPERATORS = "=~≈∈∑∫"
