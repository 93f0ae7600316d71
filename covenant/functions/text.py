"""Scalar column functions.

All are built from ``pyspark.sql.functions`` so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from covenant import schemas as S

# White space as Java's ``Character.isWhitespace`` has it (used by strip and isBlank), and as Python's
# ``str.split`` has it: that adds next line and the spaces that do not break.
_JAVA_WS = r"\t-\r\x1c-\x20\u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000"
_PY_WS = _JAVA_WS + r"\x85\xa0\u2007\u202f"
# Most characters of a text, none of them white space. Named first, as Java tries the many ranges of the white
# space one after the other for each character.
_VISIBLE = r"!-~\xa1-\u167f\u3001-\x{10ffff}"
_JAVA_GAP, _PY_GAP = (f"[[^{_VISIBLE}]&&[{ws}]]+" for ws in (_JAVA_WS, _PY_WS))
_STRIP = f"^{_JAVA_GAP}|{_JAVA_GAP}$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Java ``String.strip()``: remove leading/trailing white space."""
    return F.regexp_replace(_c(col), _STRIP, "")


def is_blank(col) -> Column:
    """Java ``isBlank``; null counts as blank. The search ends at the first character that is not white space."""
    return F.coalesce(~_c(col).rlike(f"[^{_JAVA_WS}]"), F.lit(True))


# ---- P1, P2 ---------------------------------------------------------------

def has_clause(answers) -> Column:
    """The answer list is non-empty (a null list counts as empty)."""
    return F.coalesce(F.size(_c(answers).getField("text")), F.lit(0)) > 0


_QUOTED = r'"(.*?)"'


def clause_name(question) -> Column:
    """Text between the first pair of double quotes, else the question."""
    q = _c(question)
    return F.when(q.rlike(_QUOTED), F.regexp_extract(q, _QUOTED, 1)).otherwise(q)


# ---- F1–F3 ----------------------------------------------------------------

def first_words(col, n: int = S.WORDS_PER_CLAUSE) -> Column:
    """the first ``n`` whitespace words joined by one space (Python's ``' '.join(s.split()[:n])``).

    A regex captures the first ``n`` words and stops there, so a long text is
    never split into all its words; both functions stay in generated code.
    """
    word, gap = f"[[{_VISIBLE}][^{_PY_WS}]]+", _PY_GAP
    head = F.regexp_extract(_c(col), f"^(?:{gap})?({word}(?:{gap}{word}){{0,{n - 1}}})", 1)
    return F.regexp_replace(head, gap, " ")


def risk_label(score) -> Column:
    """right-closed buckets (-1,2] Low, (2,4] Medium, (4,10] High, else null."""
    s = _c(score)
    out = None
    lo = S.LABEL_LOWER_BOUND
    for label, hi in zip(S.LABELS, S.LABEL_UPPER_BOUNDS):
        cond = (s > F.lit(lo)) & (s <= F.lit(hi))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
        lo = hi
    return out


def label_id(label) -> Column:
    """label -> 0/1/2 (unknown -> null)."""
    lab = _c(label)
    out = None
    for i, name in enumerate(S.LABELS):
        out = (F.when(lab == name, F.lit(i)) if out is None else out.when(lab == name, F.lit(i)))
    return out


def id_label(idx) -> Column:
    """F3 inverse: 0/1/2 -> label (out of range -> null)."""
    return F.try_element_at(F.array(*[F.lit(x) for x in S.LABELS]), _c(idx).cast("int") + F.lit(1))


# ---- F4–F10 ---------------------------------------------------------------

def content_hash(col) -> Column:
    """SHA-256 hex of bytes (strings are hashed as UTF-8)."""
    return F.sha2(_c(col), 256)


def short_hash(col) -> Column:
    """first 12 chars + '…'; null -> ''."""
    h = _c(col)
    return F.when(h.isNull(), F.lit("")).otherwise(F.concat(F.substring(h, 1, 12), F.lit("…")))


def utf16_length(col) -> Column:
    """Java ``length()``: UTF-16 units."""
    return (F.octet_length(F.encode(_c(col), "UTF-16BE")) / 2).cast("int")


def utf16_head(col, units: int) -> Column:
    """Java ``substring(0, units)``; a pair that the cut would part ends as ``?``, as it does when stored."""
    raw = F.encode(_c(col), "UTF-16BE")
    parted = F.hex(F.substring(raw, 2 * units - 1, 1)).between("D8", "DB") & (F.octet_length(raw) > 2 * units)
    return F.when(parted, F.concat(F.decode(F.substring(raw, 1, 2 * units - 2), "UTF-16BE"), F.lit("?"))) \
        .otherwise(F.decode(F.substring(raw, 1, 2 * units), "UTF-16BE"))


def clip_note(col) -> Column:
    """notes over 500 chars become the first 497 + '...'."""
    n = _c(col)
    return F.when(utf16_length(n) > S.NOTE_LIMIT,
                  F.concat(utf16_head(n, S.NOTE_LIMIT - 3), F.lit("..."))).otherwise(n)


def text_preview(file_name, text) -> Column:
    """preview only for .txt names (any case); long texts cut + marker."""
    t = _c(text)
    cut = F.when(utf16_length(t) > S.PREVIEW_LIMIT,
                 F.concat(utf16_head(t, S.PREVIEW_LIMIT), F.lit(S.PREVIEW_MARKER))).otherwise(t)
    return F.when(F.lower(_c(file_name)).endswith(".txt"), cut)


def sanitize_name(col) -> Column:
    """F8: base name, each char outside [A-Za-z0-9._-] -> '_', blank -> 'document'."""
    base = F.regexp_extract(_c(col), r"([^/]*)/*$", 1)
    clean = F.regexp_replace(base, r"[^A-Za-z0-9._-]", "_")
    return F.when(_c(col).isNull() | (clean == ""), F.lit("document")).otherwise(clean)


def storage_key(doc_id, version, file_name) -> Column:
    """``doc-<id>/v<n>/<sanitized name>``."""
    return F.concat(F.lit("doc-"), _c(doc_id).cast("string"), F.lit("/v"),
                    _c(version).cast("string"), F.lit("/"), sanitize_name(file_name))


def media_type(file_name) -> Column:
    """media type by extension."""
    lower = F.lower(_c(file_name))
    return (F.when(lower.endswith(".pdf"), F.lit("application/pdf"))
            .when(lower.endswith(".txt"), F.lit("text/plain;charset=UTF-8"))
            .otherwise(F.lit("application/octet-stream")))


def disposition(file_name) -> Column:
    """PDFs and text open inline; everything else downloads."""
    lower = F.lower(_c(file_name))
    return F.when(lower.endswith(".pdf") | lower.endswith(".txt"), F.lit("inline")).otherwise(F.lit("attachment"))


# ---- F11, F12 -------------------------------------------------------------

def _ntz(col) -> Column:
    return _c(col).cast("timestamp_ntz")


def format_ts(col) -> Column:
    """``d MMM yyyy, HH:mm`` in Asia/Kolkata; null -> ''.

    Inputs are UTC wall-clock timestamps; the conversion does not depend on
    the session time zone.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(S.DISPLAY_TZ), _ntz(col))
    return F.coalesce(F.date_format(local, S.DISPLAY_TS_FORMAT), F.lit(""))


def waiting(since, as_of) -> Column:
    """'just now' / 'n min' / 'n h' / 'n days', all floored; null -> ''."""
    mins = F.timestamp_diff("MINUTE", _ntz(since), _ntz(as_of))
    hours = F.floor(mins / 60).cast("long")
    return (F.when(_c(since).isNull(), F.lit(""))
            .when(mins < 1, F.lit("just now"))
            .when(mins < 60, F.concat(mins.cast("string"), F.lit(" min")))
            .when(hours < 48, F.concat(hours.cast("string"), F.lit(" h")))
            .otherwise(F.concat(F.floor(hours / 24).cast("long").cast("string"), F.lit(" days"))))


# ---- F13–F15, J9, A12 -----------------------------------------------------

def parse_clauses(col) -> Column:
    """JSON text -> map<string,string>; blank or malformed -> empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.when(is_blank(col), empty).otherwise(
        F.coalesce(F.from_json(_c(col), "map<string,string>"), empty))


def present_clauses(clause_map) -> Column:
    """Ordered array<struct<clause,text>> of the ten clauses with non-blank text."""
    m = _c(clause_map)
    entries = F.array(*[F.struct(F.lit(c).alias("clause"), strip(m.getItem(c)).alias("text"))
                        for c in S.RISK_CLAUSES])
    return F.filter(entries, lambda e: F.coalesce(e.getField("text") != F.lit(""), F.lit(False)))


def clause_count(clause_map) -> Column:
    """Number of the ten clauses present."""
    return F.size(present_clauses(clause_map))


def clauses_json(present) -> Column:
    """present clauses -> JSON object in the fixed order."""
    p = _c(present)
    return F.to_json(F.map_from_arrays(F.transform(p, lambda e: e.getField("clause")),
                                       F.transform(p, lambda e: e.getField("text"))))


def flagged_text(present) -> Column:
    """F15 (write side): clause names joined by ', '."""
    return F.array_join(F.transform(_c(present), lambda e: e.getField("clause")), ", ")


def flagged_list(col) -> Column:
    """F15 (read side): comma text -> trimmed list; null/blank -> []; empty parts at the end are dropped
    before trimming, as Java's ``split`` does."""
    c = _c(col)
    return F.when(is_blank(c), F.array().cast("array<string>")).otherwise(
        F.transform(F.filter(F.split(F.regexp_replace(c, ",+$", ""), ","), lambda x: c.rlike("[^,]")), lambda x: strip(x)))


# ---- F16, F17 -------------------------------------------------------------

def softmax(logits) -> Column:
    """Numerically stable softmax over an array<double>."""
    x = _c(logits)
    m = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - m))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def softmax_label(logits, labels=S.LABELS) -> Column:
    """F16: struct(risk_label, confidence, probabilities) from logits.

    First argmax wins; probabilities round half-even to 4 decimals.
    """
    p = softmax(logits)
    best = F.array_position(p, F.array_max(p))
    lab = F.array(*[F.lit(x) for x in labels])
    return F.struct(
        F.element_at(lab, best.cast("int")).alias("risk_label"),
        F.bround(F.element_at(p, best.cast("int")), 4).alias("confidence"),
        F.map_from_arrays(lab, F.transform(p, lambda v: F.bround(v, 4))).alias("probabilities"),
    )


# Word and punctuation tokens (Unicode letters/digits), the default tokenizer.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
SPECIAL_TOKENS = 2  # [CLS] and [SEP]


def tokens(col) -> Column:
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN_PATTERN), 0)


def token_count(col) -> Column:
    """tokens including the two special tokens (no truncation)."""
    return F.size(tokens(col)) + F.lit(SPECIAL_TOKENS)


def token_ids(toks, vocabulary=None, unknown: int = 100, vocab_size: int = 30522) -> Column:
    """Ids of tokens: from ``vocabulary`` (a map column, token -> id; others get ``unknown``), or without
    one from a hash into the ids above the special ones."""
    if vocabulary is None:
        return F.transform(toks, lambda t: (F.pmod(F.xxhash64(t), F.lit(vocab_size - 1000)) + 1000).cast("int"))
    v = _c(vocabulary)
    return F.transform(toks, lambda t: F.coalesce(F.try_element_at(v, t), F.lit(unknown)).cast("int"))


def token_budget(col, max_len: int = S.MAX_TOKENS, vocabulary=None) -> Column:
    """struct(n_tokens, truncated, input_ids, attention_mask).

    101 and 102 are the special tokens at the ends; sequences are truncated to
    ``max_len`` and padded with 0. ``vocabulary`` is as in ``token_ids``.
    """
    toks = tokens(col)
    body = token_ids(F.slice(toks, 1, max_len - SPECIAL_TOKENS), vocabulary)
    ids = F.concat(F.array(F.lit(101)), body, F.array(F.lit(102)))
    pad = F.greatest(F.lit(max_len) - F.size(ids), F.lit(0))
    n = F.size(toks) + F.lit(SPECIAL_TOKENS)
    return F.struct(
        n.alias("n_tokens"),
        (n >= F.lit(max_len)).alias("truncated"),
        F.concat(ids, F.array_repeat(F.lit(0), pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), pad)).alias("attention_mask"),
    )


# ---- F20, F21, F22 --------------------------------------------------------

def java_round(col) -> Column:
    """``Math.round``: half-up to a long."""
    return F.floor(_c(col) + F.lit(0.5)).cast("long")


def rule_phrase(n_present, rule_label_col) -> Column:
    return F.concat(_c(n_present).cast("string"), F.lit(S.RULE_PHRASE.format(len(S.RISK_CLAUSES))),
                    _c(rule_label_col), F.lit(")"))


def classification_note(n_present, rule_label_col, model_input, pred_label, pred_conf) -> Column:
    """note logged for a prepared contract's classification."""
    rule = rule_phrase(n_present, rule_label_col)
    return (F.when(is_blank(model_input), F.concat(F.lit(S.MSG_NO_MODEL_INPUT), rule, F.lit(".")))
            .when(_c(pred_label).isNull(), F.concat(F.lit(S.MSG_NO_CLASSIFIER), rule, F.lit(".")))
            .otherwise(F.concat(F.lit(S.MSG_PREDICTED), _c(pred_label), F.lit(" ("),
                                java_round(_c(pred_conf) * 100).cast("string"),
                                F.lit(S.MSG_CONFIDENCE), rule, F.lit("."))))


def text_length(col) -> Column:
    """characters (code points) per text."""
    return F.length(_c(col))
