"""Label / name encodings and JSON extraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Label codes, display names and loss names that must equal the reference.
DOC_LABEL_CODES = {"Normal": 0, "Abnormal": 1}
SENTENCE_LABEL_CODES = {"Yes": 0, "No": 1}  # anything else -> 2
SENTENCE_OTHER_CODE = 2
MODEL_DISPLAY_NAMES = [
    ("Bio_ClinicalBERT", "Bio_ClinicalBERT-document"),
    ("deberta-v3-base", "DeBERTa-v3-base-document"),
    ("RadBERT-RoBERTa-4m", "RadBERT-4m-document"),
]
METHOD_LOSS_NAMES = {"Baseline": "baseline loss", "Contrastive_Last_Layer": "contrastive loss"}
# ------------------------------------------------------------ end fixed values

STRICT_OBJECT = r"(?s)^\s*\{.*\}\s*$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _case(x: Column, mapping: dict, other=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(x == k, F.lit(v)) if out is None else out.when(x == k, F.lit(v)))
    return out.otherwise(F.lit(other)) if other is not None else out


def encode_label(label: Column | str) -> Column:
    """Normal→0, Abnormal→1, anything else→NULL."""
    return _case(_c(label), DOC_LABEL_CODES).cast("int")


def encode_sentence_label(label: Column | str) -> Column:
    """Yes→0, No→1, anything else (NULL included)→2."""
    return _case(_c(label), SENTENCE_LABEL_CODES, SENTENCE_OTHER_CODE).cast("int")


def extract_label_json(raw: Column | str, field: str) -> Column:
    """``get_json_object`` of one top-level field; NULL on failure."""
    return F.get_json_object(_c(raw), f"$.{field}")


def parse_json_strict_jvm(raw: Column | str, schema: str = "label string, explanation string") -> Column:
    """P18, JVM approximation: struct ``(ok, value)``; ``ok`` for text shaped
    like one object that ``from_json`` parses.  Differs from ``json.loads``
    on two concatenated objects (accepted here)."""
    raw = _c(raw)
    parsed = F.from_json(raw, f"{schema}, _corrupt_record string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record",
                          "allowSingleQuotes": "false"})
    ok = (raw.rlike(STRICT_OBJECT) & parsed.isNotNull() & parsed["_corrupt_record"].isNull())
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"),
                    F.when(ok, parsed.dropFields("_corrupt_record")).alias("value"))


def _as_text(v):
    import json

    if v is None or isinstance(v, str):
        return v
    return json.dumps(v, separators=(",", ":"))


_STRICT_UDFS: dict = {}


def _parse_strict(texts: pa.Array, names: tuple[str, ...]) -> pa.StructArray:
    """``ok`` and the named fields of each text; a text that a batch holds several times is parsed once."""
    import json

    once = texts.dictionary_encode()
    found: list[list] = [[] for _ in range(len(names) + 1)]
    for t in [*once.dictionary.to_numpy(zero_copy_only=False), None]:  # the last one is NULL
        try:
            v = json.loads(t) if t is not None else None
        except ValueError:
            v = None
        one = isinstance(v, dict)
        found[0].append(one)
        for column, n in zip(found[1:], names):
            column.append(_as_text(v.get(n)) if one else None)
    place = once.indices.fill_null(len(found[0]) - 1)
    columns = [pa.array(c, pa.string() if i else pa.bool_()).take(place) for i, c in enumerate(found)]
    return pa.StructArray.from_arrays(columns, ["ok", *names])


def parse_json_strict(raw: Column | str, fields: tuple[str, ...] = ("label", "explanation")) -> Column:
    """Struct ``(ok, value)`` with exactly ``json.loads`` semantics: ``ok``
    only when the whole text is one JSON object (trailing data, single quotes,
    truncation and non-objects fail); ``value`` holds the named fields as text.

    A small Arrow-batched helper — no built-in parser rejects trailing data
    the way the reference's parser does; replies are short, so the cost is a
    ``json.loads`` per reply."""
    out = _strict_udf(tuple(fields), False)(_c(raw))
    value = F.struct(*[out[n].alias(n) for n in fields])
    return F.struct(out["ok"].alias("ok"), F.when(out["ok"], value).alias("value"))


def parse_json_strict_each(raws: Column | str, fields: tuple[str, ...] = ("label", "explanation")) -> Column:
    """P18 of every text of an array: an array of structs ``(ok, fields…)``; the
    fields of a text that is not one object are NULL."""
    return _strict_udf(tuple(fields), True)(_c(raws))


def _strict_udf(names: tuple[str, ...], each: bool):
    """Built lazily: a module-level UDF would need a session on the Python workers that import this module."""
    if (names, each) not in _STRICT_UDFS:

        def parse(texts: pa.Array) -> pa.Array:
            return _parse_strict(texts, names)

        def parse_each(lists: pa.Array) -> pa.Array:
            lists = lists.fill_null([]) if lists.null_count else lists
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), _parse_strict(lists.flatten(), names))

        schema = "struct<ok: boolean, " + ", ".join(f"`{n}`: string" for n in names) + ">"
        _STRICT_UDFS[names, each] = F.arrow_udf(parse_each, f"array<{schema}>") if each else F.arrow_udf(parse, schema)
    return _STRICT_UDFS[names, each]


def first_text_part(parts: Column | str) -> Column:
    """Text of the first ``type='text'`` part with non-NULL text, else ``""``."""
    hits = F.filter(_c(parts), lambda p: (p["type"] == "text") & p["text"].isNotNull())
    return F.coalesce(F.get(hits, 0)["text"], F.lit(""))


def short_model_name(name: Column | str) -> Column:
    """P20: display name by substring, else unchanged."""
    name = _c(name)
    out = None
    for needle, shown in MODEL_DISPLAY_NAMES:
        hit = name.contains(needle)
        out = F.when(hit, F.lit(shown)) if out is None else out.when(hit, F.lit(shown))
    return out.otherwise(name)


def clean_name(name: Column | str) -> Column:
    """P20: ``/`` → ``_`` for file names."""
    return F.replace(_c(name), F.lit("/"), F.lit("_"))


def method_label(method: Column | str) -> Column:
    """Method tag → loss name, other → NULL."""
    return _case(_c(method), METHOD_LOSS_NAMES)


def classification_status(truth: Column | str, pred: Column | str) -> Column:
    """TP / FP / FN / TN / Unknown (positive class 1)."""
    t, p = _c(truth), _c(pred)
    return (F.when((t == 1) & (p == 1), "TP").when((t == 0) & (p == 1), "FP")
            .when((t == 1) & (p == 0), "FN").when((t == 0) & (p == 0), "TN").otherwise("Unknown"))


def utc_run_time() -> Column:
    """Run timestamp in UTC, ISO text."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                         "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
