"""Rule-based extraction with source-token provenance."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.functions.text import strip

# The reference's four rules (rule_id, entity type, pattern), in order.
BASELINE = (
    ("invoice_number_label_v1", "INVOICE_NUMBER", r"\binvoice\s*(?:number|no\.?|#)\s*[:#-]?\s*(?P<value>[A-Z0-9][A-Z0-9./_-]{2,})"),
    ("order_reference_label_v1", "ORDER_REFERENCE", r"\b(?:purchase\s+order(?:\s+(?:number|no\.?|#))?|p\.?o\.?\s*(?:number|no\.?|#)|order\s+(?:reference|ref\.?))\s*[:#-]?\s*(?P<value>[A-Z0-9][A-Z0-9./_-]{2,})"),
    ("total_amount_label_v1", "TOTAL_AMOUNT", r"\b(?:total\s+amount|amount\s+due|grand\s+total)\s*[:#-]?\s*(?P<value>(?:[A-Z]{3}\s*)?[$€£₹]?\s*\d[\d,.]*(?:\s*[A-Z]{3})?)"),
    ("invoice_date_numeric_v1", "INVOICE_DATE", r"\binvoice\s+date\s*[:#-]?\s*(?P<value>\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4})"),
)
# Entity types in declaration order.
ENTITY_TYPES = ("ORDER_REFERENCE", "INVOICE_NUMBER", "SELLER_NAME", "TOTAL_AMOUNT", "INVOICE_DATE")
#: Stands on either side of a value; one character, at which the JVM splits without a regular expression.
MARK = "\ue000"
#: What stands for it in a text that holds it while it is searched.
_STAND_IN = "\ufdd0"
# Python's classes of characters in the JVM's notation.
_CLASSES = {"s": r"\s\x1c-\x1f", "d": r"\p{Nd}", "w": r"\p{L}\p{N}_"}
# Capitals that the JVM, other than Python, doesn't hold to be in a range of their small letter's other capital.
_CAPITALS = "\u0130\u03f4\u1e9e\u2126\u212a\u212b"
_BOUNDARY = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"


_BEFORE_WORD = r"(?<![\p{L}\p{N}_])"


def _begins_word(rest: str) -> bool:
    """Whether what matches the rest of a pattern surely begins with a letter: a letter, or a group whose alternatives all do."""
    if not rest.startswith("(?:"):
        return rest[:1].isalpha() and rest[1:2] not in ("?", "*", "{", "|", ")")
    depth, alternatives = 0, [""]
    for k, c in enumerate(rest[3:], 3):
        escaped = rest[k - 1] == "\\"
        if c == ")" and not escaped and depth == 0:
            return all(map(_begins_word, alternatives)) and rest[k + 1 : k + 2] not in ("?", "*", "{")
        depth += 0 if escaped else (c == "(") - (c == ")")
        if c == "|" and not escaped and depth == 0:
            alternatives.append("")
        else:
            alternatives[-1] += c
    return False


def _jvm(pattern: str) -> str | None:
    """The pattern for the JVM with Python's classes and boundaries; null if it uses something that both treat differently."""
    out, inside, start, begun, k = [], False, 0, 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            e = pattern[k + 1 : k + 2]
            if e in _CLASSES:
                out.append(_CLASSES[e] if inside else f"[{_CLASSES[e]}]")
            elif e.lower() in _CLASSES and not inside:
                out.append(f"[^{_CLASSES[e.lower()]}]")
            elif e == "b" and not inside:
                out.append(_BEFORE_WORD if _begins_word(pattern[k + 2 :]) else _BOUNDARY)
            elif not e or e.isalnum():
                return None
            else:
                out.append(c + e)
            k += 2
            continue
        if inside:
            if c == "[" or c == "&":  # a nested class or an intersection there
                out.append("\\")
            if c == "]":
                inside = False
                own = re.compile("[" + pattern[start : k + 1], re.IGNORECASE)
                out[begun:begun] = [x for x in _CAPITALS if own.match(x)]  # in front, where a final hyphen makes no range of them
        elif c == "[":
            inside = True
            out.append(c)
            k += 1
            if pattern[k : k + 1] == "^":
                out.append("^")
                k += 1
            start, begun = k, len(out)
            if pattern[k : k + 1] == "]":
                out.append("\\]")
                k += 1
            continue
        elif c == ".":
            c = "[^\\n]"
        elif c in "$^" or c == MARK or (c == "(" and pattern[k + 1 : k + 2] == "?" and pattern[k + 2 : k + 3] not in ":P"):
            return None
        out.append(c)
        k += 1
    return "".join(out)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    entity_type: str
    pattern: str

    def __post_init__(self) -> None:
        if "value" not in re.compile(self.pattern, re.IGNORECASE).groupindex:
            raise ValueError(f"rule {self.rule_id} needs a group named value")

    def tail(self) -> str | None:
        """The pattern for the JVM with the prefix and the value as groups, if the value ends the pattern and nothing else
        needs Python; else null."""
        head, sep, value = self.pattern.partition("(?P<value>")
        head, value = _jvm(head), _jvm(value)
        if not sep or head is None or value is None or not value.endswith(")") or "(?P" in head + value:
            return None
        depth = 0
        for k, c in enumerate(value):
            escaped = k and value[k - 1] == "\\"
            depth += 0 if escaped else (c == "(") - (c == ")")
            if depth < 0 and k != len(value) - 1:
                return None
        return f"(?iuU)(?<pre>{head})(?<value>{value}" if depth < 0 else None


RULES = tuple(Rule(*r) for r in BASELINE)


SPAN = "struct<rule:int,match:int,start:int,end:int>"


def _python_spans(rules: dict[int, Rule]):
    compiled = [(k, re.compile(r.pattern, re.IGNORECASE)) for k, r in rules.items()]

    @F.pandas_udf(f"array<{SPAN}>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else [{"rule": k, "match": n, "start": m.start("value"), "end": m.end("value")} for k, p in compiled for n, m in enumerate(p.finditer(t)) if m.group("value") is not None] for t in texts])

    return spans


def _native_spans(text: Column, rules: dict[int, str]) -> Column:
    """Values are put between two private-use characters and the text is split at them. Each list of parts is a
    lambda's variable, so it is made once; a text without a match isn't split."""
    safe = F.when(text.contains(MARK), F.translate(text, MARK, _STAND_IN)).otherwise(text)
    marked = F.array(*[F.struct(F.lit(k).alias("rule"), F.regexp_replace(safe, t, f"${{pre}}{MARK}${{value}}{MARK}").alias("m")) for k, t in rules.items()])
    parts = F.transform(F.filter(marked, lambda x: x["m"].contains(MARK)), lambda x: F.struct(x["rule"].alias("rule"), F.split(x["m"], MARK).alias("p")))

    def each(x: Column) -> Column:
        def span(m: Column) -> Column:
            start = F.aggregate(F.slice(x["p"], 1, 2 * m + 1), F.lit(0), lambda a, v: a + F.length(v))
            return F.struct(x["rule"].alias("rule"), m.alias("match"), start.alias("start"), (start + F.length(F.get(x["p"], 2 * m + 1))).alias("end"))

        return F.transform(F.sequence(F.lit(0), (F.size(x["p"]) / 2).cast("int") - 1), span)

    return F.flatten(F.transform(parts, each))


def page_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Array of ``rule, match, start, end``: the value of every match of every rule in a text, rule by rule. Rules whose value
    ends the pattern run inside the JVM; others are searched by Python over Arrow."""
    native = {k: t for k, r in enumerate(rules) if (t := r.tail())}
    others = {k: r for k, r in enumerate(rules) if k not in native}
    none = F.array().cast(f"array<{SPAN}>")
    found = [F.coalesce(_native_spans(text, native), none)] if native else []
    found += [F.coalesce(_python_spans(others)(text), none)] if others else []
    return F.concat(*found) if found else none


def spans(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``document_id, page_index, rule, match, start, value``: every match of every rule on page rows ``document_id, page_index, text``. One scan."""
    rows = pages.select("document_id", "page_index", "text", F.explode(page_spans(F.col("text"), rules)).alias("s"))
    return rows.select("document_id", "page_index", "s.rule", "s.match", "s.start", F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))


def _references(text: Column, tokens: Column | None, start: Column, end: Column) -> Column:
    """Indexes of the tokens that overlap an extent. ``tokens`` are their places; without them tokens are what lies between single spaces."""
    if tokens is not None:
        return F.transform(F.filter(tokens, lambda t: (t["start"] < end) & (t["end"] > start)), lambda t: t["token_index"])
    before = lambda n: F.length(F.regexp_replace(F.substring(text, F.lit(1), n), "[^ ]", ""))
    value = F.substring(text, start + 1, end - start)
    # blanks at either end of the extent touch no further token
    lead = F.length(value) - F.length(F.regexp_replace(value, "^ +", ""))
    trail = F.length(value) - F.length(F.regexp_replace(value, " +$", ""))
    return F.when(lead < end - start, F.sequence(before(start + lead), before(end - trail))).otherwise(F.array().cast("array<int>"))


def page_entities(text: Column, tokens: Column | None = None, rules: tuple[Rule, ...] = RULES) -> Column:
    """Array of ``entity_type, raw_value, token_references, rule, match`` of a page's text.

    The value is stripped, its tokens are those its unstripped extent overlaps; values that are blank or touch no token are skipped.
    Equal values of a type on equal tokens count once, for the first rule and match. All of it is one expression: no shuffle, no join."""
    types = F.array(*[F.lit(r.entity_type) for r in rules])

    def one(s: Column) -> Column:
        value = strip(F.substring(text, s["start"] + 1, s["end"] - s["start"]))
        return F.struct(F.get(types, s["rule"]).alias("entity_type"), value.alias("raw_value"), _references(text, tokens, s["start"], s["end"]).alias("token_references"), s["rule"].alias("rule"), s["match"].alias("match"))

    found = F.filter(F.transform(page_spans(text, rules), one), lambda e: (e["raw_value"] != "") & (F.size(e["token_references"]) > 0))

    def once(own: Column) -> Column:
        def first(e: Column, before: Column) -> Column:
            same = (e["entity_type"] == before["entity_type"]) & (e["raw_value"] == before["raw_value"]) & (e["token_references"] == before["token_references"])
            return F.when(~F.coalesce(same, F.lit(False)), e)

        return F.when(F.size(own) > 1, F.array_compact(F.zip_with(own, F.concat(F.array(F.lit(None)), F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0)))), first))).otherwise(own)

    return F.get(F.transform(F.array(F.sort_array(found)), once), 0)


def entities(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``document_id, page_index, entity_type, raw_value, rule_id, token_references, first_token, last_token, n_tokens`` of page rows ``document_id, page_index,
    text`` and, if there is a column ``tokens`` (``token_index, start, end``; see ``tokens.page_texts``), the places of the page's tokens in the text. Without it
    tokens are separated by one space. See :func:`page_entities`; pages are read once and not shuffled."""
    ids = F.array(*[F.lit(r.rule_id) for r in rules])
    places = F.col("tokens") if "tokens" in pages.columns else None
    rows = pages.select("document_id", "page_index", F.explode(page_entities(F.col("text"), places, rules)).alias("e"))
    of = F.col("e.token_references")
    return rows.select("document_id", "page_index", "e.entity_type", "e.raw_value", F.get(ids, F.col("e.rule")).alias("rule_id"), of.alias("token_references"), F.get(of, F.lit(0)).alias("first_token"), F.element_at(of, -1).alias("last_token"), F.size(of).alias("n_tokens"))
