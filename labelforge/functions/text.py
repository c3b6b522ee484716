"""Column expressions for report text (P1–P6, P14–P16, P24) — all JVM-side.

Each function takes and returns ``Column``s so it composes inside one
``select`` and stays in whole-stage codegen.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Values that must equal the reference for equal results: the section
# headings, the document-level instruction, and the sentence-level system
# message and question template.  {sentence} marks where the sentence goes.
FINDINGS_REGEX = r"FINDINGS:\s*(.*?)\n\s*(IMPRESSION:|$)"  # Python re, DOTALL | IGNORECASE
IMPRESSION_REGEX = r"IMPRESSION:\s*(.*)"                     # Python re, DOTALL | IGNORECASE
DOC_INSTRUCTION = (
    "Given the input as findings and impression, output ONLY a valid & strict JSON object within {} "
    "(and strictly not string) with two fields: label (a single word: Normal, Abnormal, or Uncertain) "
    "and explanation (a detailed reason matching the label). Do not include any other text. Findings: "
)
DOC_IMPRESSION_JOIN = ". Impression: "
SENTENCE_SYSTEM = "You will be provided with a emr sentecne."
SENTENCE_TEMPLATE = '''Use the below sentence to answer the subsequent question.
    Emr_report:
    """
    {sentence}
    """
    Question: Does the patient have the specific disease in the chest based on the provied EMR report's sentence? 
    Answer form should be JSON object like following script. The JSON object has two key, "Result", and "Explanation".
    For [Result], if the sentence doesn't have enough information or evidence to classify, you should return "Uncertain". 
    If the sentence has the clear evidence that indicates absence of any abnormalities in chest, you should answer "No". 
    If the sentence has the clear observational evidence that indicates presence of any abnormalities in chest (only for present), you should answer "Yes". 

    For [Explanation], you should give a sentence more than 40 letters and less than 60 letters which explain the reason about why you choose those answers. You should elucidating the rationale behind your choice, not a direct repetition, of the input text.
    [Result] : Uncertain / No / Yes
    '''
# ------------------------------------------------------------ end fixed values

# Python's whitespace (str.isspace, re's \s) = Java's Unicode \s plus U+001C–U+001F
PY_SPACE = r"[\s\x1c-\x1f]"


def java_regex(python_regex: str) -> str:
    """A Python ``re`` pattern (DOTALL | IGNORECASE) as a Java pattern with the
    same matches: Unicode classes and case, ``$`` before a final ``\n`` only,
    and Python's whitespace set."""
    return "(?isdU)" + python_regex.replace(r"\s", PY_SPACE)


FINDINGS_PATTERN = java_regex(FINDINGS_REGEX)
IMPRESSION_PATTERN = java_regex(IMPRESSION_REGEX)
# its members one by one: a trim looks at both ends only, a pattern at every character
_SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                            0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Python's ``str.strip()`` — Unicode whitespace on both ends (Spark
    ``trim`` removes spaces only)."""
    return F.trim(_c(x), F.lit(_SPACES))


def findings(text: Column | str) -> Column:
    """FINDINGS section, stripped; ``""`` when absent (lazy up to a newline
    followed by IMPRESSION: or the end — rule D2 kept)."""
    return strip(F.regexp_extract(_c(text), FINDINGS_PATTERN, 1))


def impression(text: Column | str) -> Column:
    """IMPRESSION section to the end, stripped; ``""`` when absent."""
    return strip(F.regexp_extract(_c(text), IMPRESSION_PATTERN, 1))


def subject_id_from_path(path: Column | str) -> Column:
    """Parent folder of the report file."""
    return F.regexp_extract(_c(path), r"([^/]+)/([^/]+)\.txt$", 1)


def study_id_from_path(path: Column | str) -> Column:
    """File stem of the report file."""
    return F.regexp_extract(_c(path), r"([^/]+)/([^/]+)\.txt$", 2)


def context_space(f: Column | str, i: Column | str) -> Column:
    """NULL→"", join with one space, strip."""
    return strip(F.concat(F.coalesce(_c(f), F.lit("")), F.lit(" "), F.coalesce(_c(i), F.lit(""))))


def context_period(f: Column | str, i: Column | str) -> Column:
    """P5: strip each section, drop blank/NULL ones, join with ". "."""
    return F.concat_ws(". ", F.nullif(strip(_c(f)), F.lit("")), F.nullif(strip(_c(i)), F.lit("")))


def context_sql(f: Column | str, i: Column | str) -> Column:
    """As P4 without the strip."""
    return F.concat(F.coalesce(_c(f), F.lit("")), F.lit(" "), F.coalesce(_c(i), F.lit("")))


def doc_prompt(f: Column | str, i: Column | str) -> Column:
    """Instruction + both sections; a NULL section gives a NULL prompt."""
    return F.concat(F.lit(DOC_INSTRUCTION), _c(f), F.lit(DOC_IMPRESSION_JOIN), _c(i))


def sentence_prompt(sentence: Column | str) -> Column:
    """The sentence question (user message)."""
    head, tail = SENTENCE_TEMPLATE.split("{sentence}")
    return F.concat(F.lit(head), _c(sentence), F.lit(tail))


def sentence_prompts(sentences: pa.Array) -> pa.Array:
    """P15 of an Arrow batch, for Python workers: they get the sentences, not the template once per row."""
    head, tail, join = (pa.scalar(x, pa.large_string()) for x in (*SENTENCE_TEMPLATE.split("{sentence}"), ""))
    return pc.binary_join_element_wise(head, sentences.cast(pa.large_string()), tail, join)


def flatten_newlines(x: Column | str) -> Column:
    """Newlines → spaces before embedding / token counting."""
    return F.replace(_c(x), F.lit("\n"), F.lit(" "))


def is_blank(x: Column | str) -> Column:
    """NULL or SQL-TRIM empty (spaces only, as in the reference SQL)."""
    return _c(x).isNull() | (F.trim(_c(x)) == "")
