"""Text expressions: PII masking/redaction, guardrails, keyword intents (X-1 … X-9, X-11).

The fixed patterns in ``constants`` use Python regex syntax, where ``\\w``,
``\\d``, ``\\s`` and ``\\b`` are Unicode-aware.  Spark evaluates regexes with
java.util.regex, so the classes are written out explicitly (letters, numbers
and underscore; decimal digits; Unicode white space) and ``\\b`` becomes a
look-around on that word class.  Everything stays a native Column expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paylens import constants as C
from paylens.functions.numeric import col

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
SPACE = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"


def to_java(pattern: str) -> str:
    """Python (Unicode) regex classes -> explicit java.util.regex classes."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            repl = {"w": WORD[1:-1] if _inside_class(pattern, i) else WORD,
                    "d": DIGIT, "s": SPACE[1:-1] if _inside_class(pattern, i) else SPACE}.get(nxt)
            if nxt == "b":
                # \b next to a word character: look-behind / look-ahead on the word class
                ahead = pattern[i + 2:i + 4]
                repl = f"(?<!{WORD})" if ahead in ("\\d", "\\w") or (ahead[:1].isalnum()) else f"(?!{WORD})"
            if repl is not None:
                out.append(repl)
                i += 2
                continue
            out.append(pattern[i:i + 2])
            i += 2
            continue
        if ch == "." and not _inside_class(pattern, i):
            ch = r"[^\n]"                       # java.util.regex also stops at \r, U+0085, U+2028, U+2029
        out.append(ch)
        i += 1
    return "".join(out)


def _inside_class(pattern: str, pos: int) -> bool:
    depth, i = 0, 0
    while i < pos:
        if pattern[i] == "\\":
            i += 2
            continue
        if pattern[i] == "[":
            depth += 1
        elif pattern[i] == "]" and depth:
            depth -= 1
        i += 1
    return depth > 0


CARD_RE = to_java(C.CARD_PATTERN)
EMAIL_RE = to_java(C.EMAIL_PATTERN)
# Same matches, less work: '@' is outside the local-part class, so that run never needs
# backtracking (possessive); and texts without '@' / without four consecutive digits
# cannot match at all, so the full regexes run only on candidate texts.
EMAIL_SCAN_RE = EMAIL_RE.replace("]+@", "]++@", 1)
FOUR_DIGITS = r"\p{Nd}{4}"


def _maybe_card(s: Column) -> Column:
    return s.rlike(FOUR_DIGITS)


def _maybe_email(s: Column) -> Column:
    return F.instr(s, "@") > 0


def mask_email(c) -> Column:
    """X-1: not exactly one '@' -> unchanged; local <= 2 chars -> all '*'; else first + '*'s + last."""
    s = col(c)
    parts = F.split(s, "@", -1)
    local, domain = parts[0], parts[1]
    n = F.length(local)
    masked = F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(local, 1, 1), F.repeat(F.lit("*"), n - 2), F.substring(local, -1, 1)))
    return F.when(F.size(parts) == 2, F.concat(masked, F.lit("@"), domain)).otherwise(s)


def redact_pii(c) -> Column:
    """X-2: card numbers then e-mail addresses replaced by tags."""
    s = col(c)
    carded = F.when(_maybe_card(s), F.regexp_replace(s, CARD_RE, C.CARD_TAG)).otherwise(s)
    return F.when(_maybe_email(carded), F.regexp_replace(carded, EMAIL_SCAN_RE, C.EMAIL_TAG)).otherwise(carded)


def has_card(c) -> Column:
    s = col(c)
    return _maybe_card(s) & s.rlike(CARD_RE)


def response_guard(c) -> Column:
    """X-3: a response containing a card number is replaced whole."""
    return F.when(has_card(c), F.lit(C.RESPONSE_PII_REPLACEMENT)).otherwise(col(c))


def _any_match(c: Column, patterns: list[str]) -> Column:
    """Case-insensitive search for any pattern (one alternation, one regex scan)."""
    alt = "|".join(f"(?:{to_java(p)})" for p in patterns)
    return F.coalesce(c.rlike(f"(?iu){alt}"), F.lit(False))


def query_guard_reason(c) -> Column:
    """X-4: first failing group: cross_merchant, injection, pii; NULL when allowed."""
    s = col(c)
    return (F.when(_any_match(s, C.CROSS_MERCHANT_PATTERNS), F.lit("cross_merchant"))
            .when(_any_match(s, C.INJECTION_PATTERNS), F.lit("injection"))
            .when(_any_match(s, C.PII_REQUEST_PATTERNS), F.lit("pii")))


def sql_guard_reason(sql, merchant) -> Column:
    """X-5: merchant value must occur; the first dangerous keyword (substring) rejects."""
    up = F.upper(col(sql))
    out = F.when(~F.coalesce(F.instr(col(sql), col(merchant)) > 0, F.lit(False)), F.lit("missing_merchant_filter"))
    for kw in C.DANGEROUS_SQL_KEYWORDS:
        out = out.when(F.instr(up, F.lit(kw)) > 0, F.lit(f"dangerous:{kw}"))
    return out


def is_readonly(sql) -> Column:
    """X-6: starts with select/with and no space-delimited write keyword."""
    cand = F.lower(F.regexp_replace(col(sql), rf"^{SPACE}+|{SPACE}+$", ""))
    starts = cand.startswith("select") | cand.startswith("with")
    padded = F.concat(F.lit(" "), cand, F.lit(" "))
    blocked = None
    for tok in C.READONLY_BLOCKED_TOKENS:
        hit = F.instr(padded, F.lit(tok)) > 0
        blocked = hit if blocked is None else blocked | hit
    return (F.length(cand) > 0) & starts & ~blocked


def keyword_intent(c, intents: list[tuple[str, list[str]]], default: str) -> Column:
    """X-8 / X-9: the first intent whose keyword list has a substring of lower(text)."""
    low = F.lower(col(c))
    out = None
    for name, words in intents:
        hit = None
        for w in words:
            h = F.instr(low, F.lit(w)) > 0
            hit = h if hit is None else hit | h
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return F.coalesce(out, F.lit(default))


def token_merchant(token) -> Column:
    """X-11: merchant id from a 'merchant:<id>' token (NULL when malformed)."""
    m = F.regexp_extract(col(token), r"^merchant:(.+)$", 1)
    return F.when(m == "", F.lit(None)).otherwise(m)
