"""Personal data by anchor expansion.

An Aho-Corasick automaton walks each text once and stops at anchors: at-signs,
plus signs, digits, URL schemes and identifier cues.  From an anchor a
deterministic parser expands to the left and right and validates what it found.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import per_process, per_row, pick, with_text

# The kinds in the order of the result, base kinds first.
BASE = ("email", "ip", "card", "phone")
KINDS = ("email", "ip", "card", "phone", "secret", "iban", "account", "url")
ORDER = {k: i for i, k in enumerate(KINDS)}
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "private_key")
ACCOUNT_CUES = ("account", "acct", "ssn", "passport", "konto")
IBAN_CUES = ("iban",)
PASSWORD_CUES = ("password", "passwd")   # of the secret cues those whose values may be short
#: Characters that may stand between a cue and its value, at most.
GAP = 16
#: A word between a cue for accounts and its value.
_NAMED = re.compile(r"[ _-]?(?:number|nummer|num|nr|no|id)(?![a-z])[.]?", re.IGNORECASE | re.ASCII)
_UPPER = {c: c + 32 for c in range(65, 91)}

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LABEL = LETTERS | DIGITS | {"-"}
LOCAL = LABEL | set("._%+")
PHONE = DIGITS | set(" ().-")
VALUE = LETTERS | DIGITS | set("_-./+=")


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in DIGITS:
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for kind, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES), ("iban", IBAN_CUES)):
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def folded(text: str) -> str:
    """``text`` with A-Z in lower case, place by place."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


def _run(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Bounds of the address around the at-sign, not starting before ``floor``."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while text[end:end + 1] == "." and (nxt := _run(text, end + 1, LABEL)) > end + 1:
        end, labels = nxt, labels + 1
    return (start, end) if labels else None


def ip_at(text: str, start: int) -> tuple[int, bool] | None:
    """End of the four numbers that begin here and whether each is at most 255."""
    end, valid = start, True
    for k in range(4):
        if k:
            if text[end:end + 1] != ".":
                return None
            end += 1
        nxt = _run(text, end, DIGITS)
        if nxt == end:
            return None
        part = text[end:nxt].lstrip("0")
        valid &= len(part) < 4 and int(part or 0) <= 255
        end = nxt
    return end, valid


def digits_at(text: str, start: int) -> int:
    """End of the digits that follow each other with at most one blank or hyphen between."""
    end = start + 1
    while True:
        if text[end:end + 1] in DIGITS:
            end += 1
        elif text[end:end + 1] in (" ", "-") and text[end + 1:end + 2] in DIGITS:
            end += 2
        else:
            return end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def phone_at(text: str, at: int) -> int | None:
    if text[at + 1:at + 2] not in DIGITS:
        return None
    end = _run(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end > at + 3 else None


def _value_after(text: str, at: int, gap: int) -> int:
    """Start of the value behind a cue: blanks, one of ``=:#`` and an opening quote may stand between."""
    limit, marks = at + gap, 0
    while at < limit and (c := text[at:at + 1]):
        if c in "=:#":
            marks += 1
            if marks > 1:
                break
        elif c not in " \"'":
            break
        at += 1
    return at


class Runs:
    """The last run of a kind of characters that was scanned.  A later start inside it ends where it ends, so that
    texts full of cues are scanned once."""

    def __init__(self, text: str, inside, trim: str = ""):
        self.text, self.inside, self.trim = text, inside, trim
        self.begin = self.end = self.cut = 0
        self.digit = self.letter = self.other = -1   # last places of a digit, a letter, and anything but a letter

    def at(self, start: int) -> int:
        """End of the run that holds ``start``, without trailing ``trim``; ``start`` if there is none."""
        text = self.text
        if not self.begin <= start < self.end:
            end = start
            while end < len(text) and self.inside(text[end]):
                end += 1
            self.begin, self.end, self.cut = start, end, end
            while self.cut > start and text[self.cut - 1] in self.trim:
                self.cut -= 1
            self.digit = self.letter = self.other = -1
            for i in range(start, self.cut):
                c = text[i]
                if c in LETTERS:
                    self.letter = i
                else:
                    self.other = i
                    if c in DIGITS:
                        self.digit = i
        return max(start, self.cut)


def secret_at(text: str, cue_end: int, start: int, values: Runs, passwords: Runs) -> tuple[int, int] | None:
    """Bounds of the value that begins at ``start`` behind a cue."""
    between = set(text[cue_end:start])
    if not {"=", ":"} & between:
        return None
    if folded(text[max(0, cue_end - 8):cue_end]).endswith(PASSWORD_CUES):
        end = passwords.at(start)
        # Plain letters behind a colon may be prose.
        return (start, end) if end - start >= 4 and (between & set("=\"'") or passwords.other >= start) else None
    end = values.at(start)
    return (start, end) if end - start >= 16 and values.digit >= start and values.letter >= start else None


def iban_at(text: str, start: int) -> tuple[int, int] | None:
    end, got = start, ""
    best = None
    while end < len(text) and len(got) < 34:
        c = text[end]
        if c in LETTERS or c in DIGITS:
            got += c.upper()
        elif c != " " or not got:
            break
        end += 1
        if len(got) >= 15 and got[:2].isalpha() and got[2:4].isdigit() and text[end:end + 1] not in LETTERS | DIGITS:
            if int("".join(str(int(x, 36)) for x in got[4:] + got[:4])) % 97 == 1:
                best = (start, end)
    return best


def account_at(text: str, cue_end: int, start: int) -> tuple[int, int] | None:
    if start == cue_end:
        return None
    if text[start:start + 1] in DIGITS:
        end = digits_at(text, start)
        if 6 <= sum(c in DIGITS for c in text[start:end]) <= 18:
            return start, end
    if folded(text[max(0, cue_end - 8):cue_end]) == "passport":   # letters and digits in any order
        end = _run(text, start, LETTERS | DIGITS)
        if 6 <= end - start <= 12 and sum(c in DIGITS for c in text[start:end]) >= 4:
            return start, end
    return None


def url_at(text: str, at: int) -> tuple[int, int] | None:
    """``at``: place of ``://``."""
    start, n = at, len(text)
    while start and (text[start - 1] in LETTERS or text[start - 1] in DIGITS or text[start - 1] in "+.-"):
        start -= 1
    while start < at and text[start] not in LETTERS:
        start += 1
    end = at + 3
    while end < n and not text[end].isspace() and text[end] not in "<>\"'`|":
        end += 1
    while end > at + 3 and text[end - 1] in ".,;:!?)]}":
        end -= 1
    return (start, end) if start < at and end > at + 3 else None


def find(text: str, anchors, gap: int = GAP) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by start and kind; code points, end exclusive.

    Per kind the spans are the leftmost that don't overlap; a candidate that
    fails its check is passed over as a whole.  Values behind cues begin at most
    ``gap`` characters after them.  Anchors inside a found span of their kind are passed over unread, and
    runs are scanned once, so the time grows with the text's length.
    """
    spans, done = [], dict.fromkeys(KINDS, 0)
    values = Runs(text, VALUE.__contains__)
    passwords = Runs(text, lambda c: not c.isspace() and c not in "\"'<>", ".,;:!?)]}")
    digits_done = 0
    for last, (what, size) in anchors.iter(folded(text)):
        at = last + 1 - size
        if what == "digit":
            if at >= done["ip"] and at >= digits_done:
                digits_done = _run(text, at, DIGITS)
                if got := ip_at(text, at):
                    done["ip"] = got[0]
                    if got[1]:
                        spans.append(("ip", at, got[0]))
            if at >= done["card"]:
                end = done["card"] = digits_at(text, at)
                number = text[at:end].replace(" ", "").replace("-", "")
                if 14 <= len(number) <= 19 and luhn(number):
                    spans.append(("card", at, end))
        elif what == "at":
            if got := email_at(text, at, done["email"]):
                spans.append(("email", *got))
                done["email"] = got[1]
        elif what == "plus":
            if at >= done["phone"] and (end := phone_at(text, at)):
                done["phone"] = end
                if 10 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                    spans.append(("phone", at, end))
        else:
            kind, got = ("url" if what == "scheme" else what), None
            if what == "scheme":
                got = url_at(text, at) if at >= done["url"] else None
            else:
                named = _NAMED.match(text, last + 1) if what == "account" else None
                start = _value_after(text, named.end() if named else last + 1, gap)
                if start >= done[kind]:
                    got = (secret_at(text, last + 1, start, values, passwords) if what == "secret"
                           else iban_at(text, start) if what == "iban" else account_at(text, last + 1, start))
            if got and got[0] >= done[kind]:
                spans.append((kind, *got))
                done[kind] = got[1]
    spans.sort(key=lambda s: (s[1], ORDER[s[0]]))
    return spans


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span becomes ``[KIND]``; overlapping spans become one, named after the first."""
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in spans:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = GAP) -> DataFrame:
    """Spans and redacted text of every row: ``doc_id, spans, redacted``.

    A row per input row, whatever its id: repeated and null ids are kept.  Null
    text counts as empty (no spans, empty redacted text); an empty table gives an
    empty result; other columns are ignored.  Texts are scanned whole, in time
    that grows with their length.  Each task holds one batch of texts.
    URLs are reported but stay in the redacted text.
    """
    def make():
        anchors = per_process(("pii",), automaton)

        def row(doc_id, text):
            spans = find(text or "", anchors, gap)
            clean = redact(text or "", [s for s in spans if s[0] != "url"])
            return doc_id, [{"kind": k, "start": a, "end": b} for k, a, b in spans], clean
        return row

    rows = pick(df, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return per_row(rows, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>, redacted string", make)


def redact_pii(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("url",), gap: int = GAP) -> DataFrame:
    """``df`` with its spans, but for the kinds in ``keep``, replaced by ``[KIND]``; null texts and other columns stay."""
    def make():
        anchors = per_process(("pii",), automaton)
        return lambda text: redact(text, [s for s in find(text, anchors, gap) if s[0] not in keep])
    return with_text(df, text_col, make)
