"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors in any case: at-signs, URL
schemes, digits, colons after hexadecimal digits and identifier cues.  Local
parsers then expand each anchor to the borders of the value and validate it; no
value is cut at a length.  Every parser is deterministic and reads a character at
most a fixed number of times, so a very long text costs time in proportion.

Base kinds (leftmost, non-overlapping within a kind):
  email  local part @ domain of at least two labels
  ip     four dotted numbers, each at most 255
  card   14 to 19 digits, singly parted by spaces or hyphens, with a valid Luhn sum
  phone  + and 10 to 15 digits
Added kinds:
  contact  an address with other letters than ASCII, or written with (at) and (dot)
  address  an IPv6 address (postal addresses are not looked for)
  account  the credentials of a URL, or what follows an identifier cue: IBAN
           (checked modulo 97), social security and account numbers, keys and tokens

Edges: a null text counts as empty; a text without matches has zero counts and
empty strings; repeated rows give repeated rows; other columns are not looked at.
Spans are code points, end exclusive.
"""

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "contact", "address", "account")
#: What an account parser is tried after, in any case.
NUMBER_CUES = ("account", "acct", "iban", "ssn", "social security", "passport", "customer id", "member id")
SECRET_CUES = ("token", "api_key", "api-key", "apikey", "api key", "secret", "password", "passwd", "access_key", "access key")
AT_CUES = ("(at)", "[at]", "{at}")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_PHONE = frozenset(" ().0123456789-")
_HEX_RUN = re.compile(r"[0-9a-fA-F:]*")
_HEX = frozenset("0123456789abcdefABCDEF:")
_NUMBER_VALUE = re.compile(r"[\s]{0,3}(?:no\.?|number|nr\.?|#)?[\s]{0,3}[:=#]?[\s]{0,3}[\"']?([A-Za-z]{0,2}[0-9][0-9A-Za-z -]{4,40})")
_SECRET_LEAD = re.compile(r"[\s]{0,3}[:=][\s]{0,3}[\"']?")
_SECRET_RUN = re.compile(r"[A-Za-z0-9+/_.=-]*")
_DOTTED = re.compile(r"\s{0,2}([A-Za-z0-9-]+(?:\s{0,2}(?:\(dot\)|\[dot\]|\{dot\}|\.)\s{0,2}[A-Za-z0-9-]+)+)", re.IGNORECASE)


def automaton():
    import ahocorasick

    anchors = ahocorasick.Automaton()
    for digit in "0123456789":
        anchors.add_word(digit, "digit")
    anchors.add_word("@", "at")
    anchors.add_word("://", "scheme")
    for left in "0123456789abcdef:":
        anchors.add_word(left + ":", "colons")
    for kind, cues in (("number", NUMBER_CUES), ("secret", SECRET_CUES), ("spelled", AT_CUES)):
        for cue in cues:
            anchors.add_word(cue, kind)
    anchors.make_automaton()
    return anchors


def _lowered(text):
    """The text in lower case, character by character."""
    return text.replace("\u0130", "i").lower()  # the one character whose lower case is two


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _email(text, at, floor):
    """(start, end) of the address around the at-sign, or None; floor: end of the match before."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    n, end, labels, i = len(text), 0, 0, at + 1
    while True:
        j = i
        while j < n and text[j] in _LABEL:
            j += 1
        if j == i:
            break
        labels, end = labels + 1, j
        if j >= n or text[j] != ".":
            break
        i = j + 1
    return (start, end) if labels > 1 else None


def _wide_email(text, at):
    """An address whose letters may be of any script; both sides need letters or digits and a dotted domain."""
    start = at
    while start > 0 and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
        start -= 1
    end = at + 1
    while end < len(text) and (text[end].isalnum() or text[end] in ".-"):
        end += 1
    while end > at and text[end - 1] in ".-":
        end -= 1
    domain = text[at + 1 : end]
    if start == at or "." not in domain or ".." in domain or domain[0] in ".-":
        return None
    return None if text[start:end].isascii() else (start, end)


def _numbers(text, runs):
    """ip, card and phone matches from the runs of digits, as (kind, start, end)."""
    out = []
    i, n = 0, len(runs)
    while i < n:  # ip: four runs joined by single dots
        j = i
        while j + 1 < n and j - i < 3 and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] == ".":
            j += 1
        if j - i == 3:
            if all(e - s < 4 and int(text[s:e]) < 256 or int(text[s:e].lstrip("0")[:4] or 0) < 256 for s, e in runs[i : j + 1]):
                out.append(("ip", runs[i][0], runs[j][1]))
            i = j + 1
        else:
            i += 1
    i = 0
    while i < n:  # card: runs joined by single spaces or hyphens
        j, digits = i, runs[i][1] - runs[i][0]
        while j + 1 < n and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
            digits += runs[j][1] - runs[j][0]
        if 14 <= digits <= 19 and luhn("".join(text[s:e] for s, e in runs[i : j + 1])):
            out.append(("card", runs[i][0], runs[j][1]))
        i = j + 1
    for i, (s, e) in enumerate(runs):  # phone: a plus sign right before a run
        if s and text[s - 1] == "+":
            end, digits, j = e, e - s, i
            while j + 1 < n and all(c in _PHONE for c in text[runs[j][1] : runs[j + 1][0]]):
                j += 1
                digits += runs[j][1] - runs[j][0]
                end = runs[j][1]
                if digits > 15:
                    break
            if 10 <= digits <= 15:
                out.append(("phone", s - 1, end))
    return out


def _ipv6(text, at, floor):
    """((start, end) or None, end of the run) of the run of hexadecimal digits and colons around at; floor: end of the run before."""
    import ipaddress

    start = at
    while start > floor and text[start - 1] in _HEX:
        start -= 1
    stop = end = _HEX_RUN.match(text, at).end()
    if end - start > 2 and text[end - 1] == ":" and text[end - 2] != ":":
        end -= 1  # a colon that ends a clause
    # eight groups of four digits and seven colons are the longest
    if not 6 <= end - start <= 39 or start > 0 and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
        return None, stop
    value = text[start:end]
    if sum(c != ":" for c in value) < 4:
        return None, stop
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return None, stop
    return (start, end), stop


def _spelled(text, cue, end):
    """An address whose at-sign is written out from cue to end; the domain has a dot, written out or not."""
    stop = cue
    while stop > 0 and cue - stop < 2 and text[stop - 1].isspace():
        stop -= 1
    start = stop
    while start > 0 and text[start - 1] in _LOCAL:
        start -= 1
    host = _DOTTED.match(text, end)
    if start == stop or not host or not re.search(r"dot|[A-Za-z0-9]\.[A-Za-z]", host[1], re.IGNORECASE):
        return None
    return start, host.end(1)


def _account(text, end):
    """The number after a cue that ends at end, if it is an IBAN, a social security number or 6 to 18 digits."""
    found = _NUMBER_VALUE.match(text, end, min(len(text), end + 80))
    if not found:
        return None
    start = found.start(1)
    value = found[1]
    iban = re.match(r"[A-Za-z]{2}[0-9]{2}(?: ?[0-9A-Za-z]){11,30}", value)
    if iban:
        for size in range(len(iban[0]), 14, -1):  # trailing words may follow the number
            code = iban[0][:size].replace(" ", "").upper()
            if 15 <= len(code) <= 34 and iban[0][size - 1] != " " and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                return start, start + size
        return None
    number = re.match(r"[0-9](?:[ -]?[0-9]){5,17}(?![0-9A-Za-z])", value)
    return (start, start + number.end()) if number else None


def _secret(text, end, run):
    """The value after a cue that ends at end; run: the last (start, end) of value characters, which cues inside it share."""
    lead = _SECRET_LEAD.match(text, end)
    if not lead:
        return None, run
    start = lead.end()
    if not run[0] <= start < run[1]:
        run = _SECRET_RUN.match(text, start).span()
    size = run[1] - start
    if size < 8 or size < 16 and not any(c.isdigit() for c in text[start : run[1]]):
        return None, run
    return (start, run[1]), run


def find(text: str, anchors):
    """(base spans, all spans) of a text; lists of (start, rank of the kind, end)."""
    base, more, runs = [], [], []
    email_end, run_start, run_end, secret_run, hex_end = 0, -1, -1, (0, 0), 0
    for last, kind in anchors.iter(_lowered(text)):
        if kind == "digit":
            if last == run_end:
                run_end += 1
            else:
                if run_end >= 0:
                    runs.append((run_start, run_end))
                run_start, run_end = last, last + 1
        elif kind == "at":
            found = _email(text, last, email_end)
            if found:
                base.append(("email", *found))
                email_end = found[1]
            if wide := _wide_email(text, last):
                more.append(("contact", *wide))
        elif kind == "scheme":
            stop = last + 1
            while stop < len(text) and not text[stop].isspace() and text[stop] not in "/?#\"'<>":
                stop += 1
            user = text.rfind("@", last + 1, stop)
            if user > last + 1:
                more.append(("account", last + 1, user))
        elif kind == "colons":
            if last >= hex_end:
                found, hex_end = _ipv6(text, last, hex_end)
                if found:
                    more.append(("address", *found))
        elif kind == "number":
            if found := _account(text, last + 1):
                more.append(("account", *found))
        elif kind == "secret":
            found, secret_run = _secret(text, last + 1, secret_run)
            if found:
                more.append(("account", *found))
        elif kind == "spelled":
            if found := _spelled(text, last - 3, last + 1):
                more.append(("contact", *found))
    if run_end >= 0:
        runs.append((run_start, run_end))
    if runs:
        base += _numbers(text, runs)
    order = {kind: i for i, kind in enumerate(KINDS)}
    base = sorted((s, order[k], e) for k, s, e in base)
    return base, sorted({*base, *((s, order[k], e) for k, s, e in more)})


def _joined(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, base_sha256, spans, n_added."""
    id_type = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches):
        import pyarrow as pa

        anchors = automaton()
        names = [part.split()[0] for part in schema.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for text in part.column(1).to_pylist():
                    base, spans = find(text or "", anchors)
                    counts = [0] * len(KINDS)
                    for _, kind, _ in base:
                        counts[kind] += 1
                    rows.append((*counts[:4], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base)))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                columns = zip(*rows, strict=True) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)]], names=names)

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)
