"""Secret scans that read assignments.

Two kinds of findings. Base patterns find values by their own shape. The lexer reads source
and configuration syntax (``name = "literal"``, ``name: value``, ``"name": "literal"``,
``name := a + "literal"``, ``name: type = "literal"``, ``table["name"] = "literal"``, ``name = ["literal", name]``) into pairs of a target name and terms, follows constants from name
to name, and scores every literal that ends up in a sensitively named target by that name.
"""

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Fixed patterns with the group whose length counts and the least length. ASCII letters only.
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
KINDS = {kind: i for i, (kind, *_) in enumerate(BASE)} | {"literal": len(BASE)}

#: Weights of words in a target name, after splitting at case changes and punctuation.
NAME_WEIGHTS = {
    "password": 1.0, "passwords": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passphrases": 1.0, "secret": 1.0, "secrets": 1.0, "token": 0.9, "tokens": 0.7, "apikey": 0.9,
    "credential": 0.9, "credentials": 0.9, "private": 0.5, "auth": 0.5, "access": 0.4, "api": 0.4, "key": 0.4, "keys": 0.4, "signing": 0.4,
    "encryption": 0.4, "pass": 0.8, "pin": 0.4, "salt": 0.5, "bearer": 0.7,
}
#: Words after which a name speaks about a secret instead of holding one.
HARMLESS = {"length", "len", "size", "count", "field", "name", "file", "path", "url", "type", "policy", "id", "hint", "label", "expiry", "ttl"}
PLACEHOLDER = re.compile(r"(?i)\A(?:none|null|nil|true|false|undefined|changeme|change_me|example|placeholder|redacted|x+|\*+|\.+|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|%s)\Z")
#: Names whose quoted values may be several words.
PHRASES = {"password", "passwords", "passwd", "pwd", "passphrase", "passphrases", "pass"}
LEAST_SCORE = 0.6

#: The rest of a quoted literal after its opening quote. A quote before a letter is an apostrophe.
QUOTED = {q: re.compile(rf"""((?:[^{q}\\\n]|\\.)*+){q}(?!\w)""") for q in "\"'"}
# subscripts, a type after the colon (db_pwd: str | None =), a type between blanks (password string =), and what starts a term
SUBSCRIPTS = r"""(?:[ \t]*+\[(?:"[^"\n]*+"|'[^'\n]*+'|[^\[\]"'\n])*+\])*+"""
ONE_TYPE = r"""[&*]*+(?:'\w++[ \t]++)?(?:\[\])*+[A-Za-z_][\w.]*+(?:::\w++)*+(?:<(?:[^<>=\n]|<[^<>=\n]*+>)*+>|\[(?:[^\[\]=\n]|\[[^\[\]=\n]*+\])*+\])*+[?!]?"""
STATEMENT = re.compile(
    r"""(?<![\w.\-])(?:(?:var|const|let|static|final)[ \t]++(?P<first>[A-Za-z_]\w*+)[ \t]++(?:\[\]|\*)*+(?=[A-Za-z_]))?"""
    rf"""["']?(?P<name>[A-Za-z_][\w.\-]*+)["']?(?P<keys>{SUBSCRIPTS})"""
    rf"""(?:[?!]?[ \t]*+:[ \t]*+(?P<type>{ONE_TYPE}(?:[ \t]*+\|[ \t]*+{ONE_TYPE})*+)[ \t]*+=(?![=~>])(?=[ \t]*+[\w"'`\[])"""
    r"""|(?:[ \t]++(?:\[\]|\*)*+(?:string|byte|rune))?[ \t]*+(?:=>|:=|=(?![=~>])|:(?![:/])))[ \t]*+""", re.A)
KEY = re.compile(r"""\[[ \t]*+(?:[rbufRBUF]{0,2}"([^"\n]++)"|[rbufRBUF]{0,2}'([^'\n]++)'|:([A-Za-z_]\w*+))[ \t]*+\]""", re.A)
#: What may stand between the values of a list: blanks, commas, line ends, comments, arguments of a call.
BETWEEN = re.compile(r"""(?:[\s,]|#[^\n]*+|//[^\n]*+|\([^()\n]*+\))*+""")
TERM = re.compile(r"""(?:[rbufRBUF]{0,2}"((?:[^"\\\n]|\\.)*+)"|[rbufRBUF]{0,2}'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`|([^\s,;#"'`{}\[\]()+]++))[ \t]*+(\+|\.\.)?[ \t]*+""")
NAME = re.compile(r"\A[A-Za-z_][\w.\-]*\Z", re.A)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")


def name_weight(name: str) -> float:
    """0 to 1: how sure a name is to hold a secret. Compound hints (api + key) add up."""
    words = [w.lower() for w in WORD.findall(name)]
    if not words or words[-1] in HARMLESS:
        return 0.0
    return min(1.0, sum(NAME_WEIGHTS.get(w, 0.0) for w in set(words)))


def value_weight(value: str, quoted: bool, phrase: bool = False) -> float:
    """0 to 1: how much a literal looks like a secret: long, mixed, without blanks unless it may be a ``phrase``."""
    if len(value) < 6 or PLACEHOLDER.match(value) or re.search(r"\s", value) and not (quoted and phrase):
        return 0.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    mixed = bool(re.search(r"\d", value)) and bool(re.search(r"[A-Za-z]", value))
    if not quoted and not (mixed and len(value) >= 8):
        return 0.0
    return min(1.0, 0.4 + 0.1 * entropy + 0.2 * mixed)


def literals(text: str) -> list[tuple[int, int, float]]:
    """Spans and scores of literals that reach a sensitive name, directly or through constants."""
    if "=" not in text and ":" not in text:
        return []
    own: dict[str, list[tuple[int, int, bool]]] = {}
    refers: dict[str, list[str]] = {}
    weights: dict[str, float] = {}
    phrases: set[str] = set()
    at = 0
    while m := STATEMENT.search(text, at):
        at = m.end()
        keys = ["".join(k) for k in KEY.findall(m["keys"])]
        names = [".".join([m["name"], *keys])]
        # of two words before the sign either may be the name: var password string, const String password, INFO: password
        if (other := m["first"] or m["type"]) and not name_weight(names[0]) and HARMLESS.isdisjoint(w.lower() for w in WORD.findall(names[0])[-1:]):
            names.append(other)
        targets = {n.rsplit(".", 1)[-1]: n for n in names}
        for key, name in targets.items():
            weights[key] = max(weights.get(key, 0.0), name_weight(name))
            if not PHRASES.isdisjoint(w.lower() for w in WORD.findall(name)):
                phrases.add(key)

        def take(start: int, end: int, quoted: bool) -> None:
            value = text[start:end]
            named = not quoted and NAME.match(value)
            for key in targets:
                if not named or re.search(r"\d", value):
                    own.setdefault(key, []).append((start, end, quoted))
                if named:
                    refers.setdefault(key, []).append(value.rsplit(".", 1)[-1])

        if m["type"] and text[at:at + 1] not in "\"'`[":
            take(*m.span("type"), False)
        # statements inside a list are read by themselves as well
        depth, inner = 0, at if text.startswith("[", at) else None
        while True:
            while (depth or text.startswith("[", at)) and (sign := BETWEEN.match(text, at)).end() < len(text):
                at = sign.end()
                if text[at] not in "[]":
                    break
                depth += 1 if text[at] == "[" else -1
                at += 1
                if not depth:
                    break
            if depth == 0 and text[at - 1] == "]":
                break
            t = TERM.match(text, at)
            if not t:
                break
            quoted = t[4] is None
            group = next(g for g in (1, 2, 3, 4) if t[g] is not None)
            if not quoted and (depth or not NAME.match(t[4]) or re.search(r"\d", t[4])) and STATEMENT.match(text, at):
                break
            if quoted and depth and text[t.end():t.end() + 1] in (":", "="):
                break
            take(*t.span(group), quoted)
            at = t.end()
            if not t[5] and not depth:
                break
        if inner is not None:
            at = inner
    best: dict[tuple[int, int], float] = {}
    # names come in falling weight, so what one has reached no later one of its kind can raise
    reached: dict[bool, set[str]] = {False: set(), True: set()}
    for target in sorted(weights, key=lambda k: -weights[k]):
        weight, seen = weights[target], reached[target in phrases]
        if weight < LEAST_SCORE:
            break
        if target in seen:
            continue
        seen.add(target)
        todo = [target]
        while todo:
            here = todo.pop()
            for start, end, quoted in own.get(here, ()):
                score = weight * value_weight(text[start:end], quoted, target in phrases)
                if score >= LEAST_SCORE:
                    best[start, end] = max(best.get((start, end), 0.0), score)
            new = [r for r in refers.get(here, ()) if r not in seen and r in weights]
            seen.update(new)
            todo += new
    return [(*span, round(score, 4)) for span, score in best.items()]


def scan(text: str | None) -> list[dict]:
    """All findings of one text by start, then kind; ``value_start`` marks where the secret itself begins."""
    found: list[dict] = []
    if not text:
        return found
    spans = {(start, end): score for start, end, score in literals(text)}
    for kind, pattern, group, least in BASE:
        if kind == "access" and "AKIA" not in text or kind == "hex" and not HEX_RUN.search(text):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append({"kind": kind, "start": m.start(), "end": m.end(), "value_start": m.start(group), "score": 1.0})
                # the value of a quoted assignment goes on to the closing quote
                if kind == "assign" and (rest := QUOTED.get(text[m.start(group) - 1])) and (whole := rest.match(text, m.start(group))):
                    spans.setdefault(whole.span(1), 1.0)
    covered = sorted((f["value_start"], f["end"]) for f in found)
    reach, ends = 0, []
    for _, end in covered:
        reach = max(reach, end)
        ends.append(reach)
    for (start, end), score in spans.items():
        i = bisect_left(covered, (start + 1, -1))
        if not i or ends[i - 1] < end:  # no base value holds all of it
            found.append({"kind": "literal", "start": start, "end": end, "value_start": start, "score": score})
    return sorted(found, key=lambda f: (f["start"], KINDS[f["kind"]], f["end"]))


def redact(text: str, found: list[dict], mark: str) -> str:
    out, at = [], 0
    for start, end in sorted((f["value_start"], f["end"]) for f in found):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:int,end:int,value_start:int,score:double>>"


def secret_spans(text: Column) -> Column:
    """Findings per text: code points, end exclusive. NULL and empty texts have none."""
    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([scan(t) for t in texts], dtype=object)
    return spans(text)


def redacted_text(text: Column, mark: str = "[SECRET]") -> Column:
    """The text with every secret replaced by ``mark``; names and the rest stay. NULL stays NULL."""
    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([t and redact(t, scan(t), mark) for t in texts], dtype=object)
    return cleaned(text)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its findings ``secrets``, one row per row of ``docs``, in any order.

    Rows are read one by one: repeated rows and NULL ids need no care, an empty table gives no
    rows, other columns are ignored. Ties (several kinds at one place) are all kept.
    """
    return docs.select(F.col(id_col).alias("doc_id"), secret_spans(F.col(text_col)).alias("secrets"))


def redacted(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in the text and the length column, where there is one, brought up to date."""
    out = docs.withColumn(text_col, redacted_text(F.col(text_col)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(
            F.length(text_col)).cast(docs.schema[length_col].dataType))
    return out
