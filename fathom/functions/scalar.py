"""Functions of the expression language on Python values, for rows that are evaluated within a document.

Values are str, float, bool, datetime or None. Positions count from 0, characters are code points.
"""

from __future__ import annotations

import calendar
import datetime as dt
import html as _html
import math
import re
from collections.abc import Callable
from urllib.parse import unquote_plus

FUNCTIONS: dict[str, Callable] = {}

#: Names that the language has for the same function.
ALIASES = {"mid": "substr", "instr": "strfind", "isempty": "isblank", "get_emails": "get_email", "toupper": "upper", "tolower": "lower"}

#: Entities that the language decodes, beside numeric ones; others stay: fixed values.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "bslash": "\\", "amp": "&"}

#: Characters that URL encoding leaves as they are, beside letters and digits: fixed values. A plus is none, as it stands for a space.
URL_SAFE = "-_.~!*'(),/=;@:?&$"

_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_ENTITY = re.compile(r"&(?:#(\d+)|#[xX]([0-9a-fA-F]+)|(nbsp|lt|gt|quot|bslash|amp));", re.I)


def text_of(v) -> str | None:
    """How a value is printed: numbers without a fraction as integers, others with up to 6 digits, cut and not rounded."""
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "1" if v else "0"
    if isinstance(v, dt.datetime):
        return v.strftime("%Y/%m/%d %H:%M:%S")
    if v == int(v) if math.isfinite(v) else False:
        return str(int(v))
    cut = f"{v:.10f}"[:-4].rstrip("0") if math.isfinite(v) else str(v)
    return cut.rstrip(".")


def number(v) -> float:
    """A value as a number: the longest number that the text begins with, else 0."""
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.timestamp()
    m = _NUMBER.match(v.strip()) if v else None
    return float(m[0]) if m else 0.0


def looks_numeric(v) -> bool:
    return isinstance(v, (int, float)) or isinstance(v, str) and bool(v.strip()) and _NUMBER.fullmatch(v.strip()) is not None


def register(fn: Callable) -> Callable:
    FUNCTIONS[fn.__name__.rstrip("_")] = fn
    return fn


def lookup(name: str) -> Callable | None:
    return FUNCTIONS.get(ALIASES.get(name, name))


def _s(v) -> str:
    return text_of(v) or ""


@register
def substr(s, start=0, size=None):
    s, a = _s(s), max(0, int(number(start)))
    return s[a : a + max(0, int(number(size)))] if size is not None else s[a:]


@register
def ltrim(s, chars=" \t\n\r\x0b\x0c"):
    return _s(s).lstrip(_s(chars))


@register
def rtrim(s, chars=" \t\n\r\x0b\x0c"):
    return _s(s).rstrip(_s(chars))


@register
def strcat(*args):
    return "".join(map(_s, args))


@register
def strcmp(a, b):
    a, b = _s(a), _s(b)
    return float((a > b) - (a < b))


@register
def strcmpi(a, b):
    return strcmp(_s(a).lower(), _s(b).lower())


@register
def replace(s, old=None, new="", case=True):
    s, old, new = _s(s), _s(old), _s(new)
    if not old:
        return ""
    if text_of(case) in ("0", "false"):
        return re.sub(re.escape(old), lambda _: new, s, flags=re.I)
    return s.replace(old, new)


@register
def lower(s):
    return _s(s).lower()


@register
def upper(s):
    return _s(s).upper()


@register
def strlen(s):
    """UTF-8 bytes."""
    return float(len(_s(s).encode()))


@register
def strfind(s, what, start=0):
    return float(_s(s).find(_s(what), int(number(start))))


@register
def chr_(n):
    return chr(int(number(n)))


@register
def ascii_(s):
    return float(ord(_s(s)[0])) if _s(s) else 0.0


@register
def format_(pattern, *args):
    out, at = [], 0
    left = list(args)
    for m in re.finditer(r"%([-+ 0#]*)(\d*)(?:\.(\d+))?[hlL]*([diouxXeEfgGcs%])", pattern := _s(pattern)):
        out.append(pattern[at : m.start()])
        at = m.end()
        if m[4] == "%":
            out.append("%")
            continue
        v = left.pop(0) if left else ""
        spec = f"%{m[1]}{m[2]}" + (f".{m[3]}" if m[3] else "")
        out.append((spec + "s") % _s(v) if m[4] in "sc" else (spec + ("d" if m[4] in "iu" else m[4])) % (int(number(v)) if m[4] in "diuoxX" else number(v)))
    return "".join(out) + pattern[at:]


@register
def packnull(s):
    return _s(s).replace("\0", "")


@register
def get_number(s, which=1):
    """The n-th number in a text, from the end below 0; none: NULL."""
    found, n = _NUMBER.findall(_s(s)), int(number(which)) or 1
    return float(found[n - 1 if n > 0 else n]) if 0 < abs(n) <= len(found) else None


def html_decode_text(s: str) -> str:
    return _ENTITY.sub(lambda m: ENTITIES[m[3].lower()] if m[3] else _char(int(m[1] or m[2], 10 if m[1] else 16)), s)


def _char(code: int) -> str:
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else ""


@register
def html_decode(s):
    return html_decode_text(_s(s))


@register
def html_encode(s):
    return re.sub(r"""[<>"'\\&]""", lambda m: {"<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;", "\\": "&bslash;", "&": "&amp;"}[m[0]], _s(s))


@register
def url_encode(s):
    return "".join(c if c.isascii() and c.isalnum() or c in URL_SAFE else "+" if c == " " else "".join(f"%{b:02X}" for b in c.encode()) for c in _s(s))


@register
def url_decode(s):
    return unquote_plus(_s(s))


@register
def utf8_encode(s):
    return _s(s).encode().decode("latin-1")


@register
def ischar(s):
    return re.match(r"\s*[A-Za-z_]", _s(s)) is not None


@register
def isnumber(s):
    return re.match(r"\s*[0-9]", _s(s)) is not None


@register
def isblank(s):
    return not _s(s).strip()


@register
def isphonenumber(s):
    s = _s(s).strip()
    return 6 <= len(s) <= 20 and re.fullmatch(r"[-+()\d\s./]*\d[-+()\d\s./]*", s) is not None


_WORDS = re.compile(r"[^\x00-\x7F]|[A-Za-z0-9_]+")


@register
def text_words(s, kind="count", option=""):
    """count: words, each character beyond ASCII one; first: the first n words; text: the first n pieces; repeat: runs of words that occur n times or more (twice by default), longest first, one a line."""
    s, kind = _s(s), _s(kind).lower() or "count"
    if kind == "count":
        return float(len(_WORDS.findall(s)))
    n = int(number(option)) or 1
    if kind == "first":
        found = list(_WORDS.finditer(s))[:n]
        return s[found[0].start() : found[-1].end()] if found else ""
    if kind == "repeat":
        words, least, seen = [w.lower() for w in _WORDS.findall(s)], max(2, n), {}
        for size in range(1, 9):
            for i in range(len(words) - size + 1):
                run = tuple(words[i : i + size])
                seen[run] = seen.get(run, 0) + 1
        return "\n".join(" ".join(r) for r, c in sorted(seen.items(), key=lambda x: (-len(x[0]), -x[1], x[0])) if c >= least)
    if kind == "subsentence":
        return "\n".join(p.strip() for p in re.split(r"[.,;:!?\n]+", s) if p.strip())
    return "\n".join(s.split("\n")[:n])


@register
def get_email(s, pattern=""):
    """Addresses, one a line; in a pattern %m stands for the address and %n for the words before it."""
    out = []
    for m in re.finditer(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", s := _s(s), re.A):
        before = re.search(r"((?:[A-Z][\w'-]*\s+)*[A-Z][\w'-]*)[\s<(\"]*\Z", s[: m.start()])
        out.append((_s(pattern) or "%m").replace("%m", m[0]).replace("%n", before[1] if before else ""))
    return "\n".join(out)


@register
def string_comp(a, b, kind="prefix", option=""):
    from fathom.operators.alignment import align, local_alignments

    a, b, kind = _s(a), _s(b), _s(kind).lower()
    if kind.startswith("prefix"):
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[:n] if kind == "prefix" else float(n)
    if kind.startswith("local"):
        found = local_alignments(a, b)
        return (found[0].score if found else 0.0) if kind.endswith("score") else (found[0].x if found else "")
    cost, x, y = align(a, b)
    return {"align_cost": cost, "align_length": float(len(x)), "align_str1": x, "align_str2": y}.get(kind)


@register
def match_local_score(a, b, kind="CHAR"):
    from fathom.operators.alignment import local_alignments

    split = (lambda s: _s(s).split()) if _s(kind).upper() == "WORD" else _s
    found = local_alignments(split(a), split(b))
    return found[0].score if found else 0.0


# ---- numbers


@register
def round_(x):
    x = number(x)
    whole = int(x + 1e-10)
    return float(whole + (1 if x - whole >= 0.5 - 1e-10 else 0))


@register
def floor(x):
    return float(int(number(x) + 1e-10))


@register
def ceil(x):
    return float(int(number(x) + 1 - 1e-10))


@register
def abs_(x):
    return abs(number(x))


@register
def min_(*args):
    return min(map(number, args)) if args else None


@register
def max_(*args):
    return max(map(number, args)) if args else None


@register
def sum_(*args):
    return float(sum(map(number, args)))


@register
def count(*args):
    return float(len(args))


@register
def to_number(s):
    return number(s)


@register
def rand(*args):
    import random

    return random.random() * (number(args[0]) if args else 1.0)


@register
def getfilepath(s):
    return _s(s)[: max(_s(s).rfind("/"), _s(s).rfind("\\")) + 1]


@register
def getfilename(s):
    return _s(s)[max(_s(s).rfind("/"), _s(s).rfind("\\")) + 1 :]


@register
def query(source, text, url=None, *variables):
    """The first cell that a query gives on a text; names and values of its variables may follow."""
    from fathom.operators.interpret import run
    from fathom.plans.parser import parse

    pairs = {_s(n): _s(v) for n, v in zip(variables[::2], variables[1::2], strict=False)}
    found = run(_s(source), parse(_s(text)), text_of(url), pairs).values()
    return found[0][0] if found and found[0] else None


@register
def gethostname(url):
    from fathom.functions.urls import host_name

    return host_name(_s(url))


@register
def getdomainname(url):
    from fathom.functions.urls import domain_name

    return domain_name(_s(url))


@register
def getpathname(url):
    from fathom.functions.urls import path_name

    return path_name(_s(url))


# ---- dates

#: Date tokens of the format language, longest first, and how Python prints them: fixed values.
DATE_TOKENS = {
    "SYYYY": "%Y", "YYYY": "%Y", "YYY": None, "YY": "%y", "YEAR": "%Y", "MONTH": "%B", "MON": "%b", "MM": "%m", "DDD": "%j", "DD": "%d",
    "DAY": "%A", "DY": "%a", "HH24": "%H", "HH12": "%I", "HH": "%I", "MI": "%M", "SSSSS": None, "SS": "%S", "AM": "%p", "PM": "%p",
    "WW": "%W", "Q": None, "W": None, "D": None, "Y": None,
}
DEFAULT_DATE = "YYYY/MM/DD HH24:MI:SS"
_DATE_TOKEN = re.compile("|".join(sorted(DATE_TOKENS, key=len, reverse=True)), re.I)


def as_date(v) -> dt.datetime | None:
    if isinstance(v, dt.datetime) or v is None:
        return v
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return dt.datetime.fromtimestamp(v, dt.timezone.utc).replace(tzinfo=None)
    m = re.match(r"\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[ T](\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?", v)
    try:
        return dt.datetime(*(int(x or 0) for x in m.groups())) if m else None
    except ValueError:
        return None


@register
def sysdate():
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


@register
def time_(v=None):
    d = as_date(v) if v is not None else sysdate()
    return d.replace(tzinfo=dt.timezone.utc).timestamp() if d else None


@register
def date(v=None):
    return as_date(v) if v is not None else sysdate()


@register
def to_date(s, pattern=None, default=None):
    if pattern is None:
        return as_date(s) or as_date(default)
    form = _DATE_TOKEN.sub(lambda m: DATE_TOKENS[m[0].upper()] or m[0], _s(pattern).replace("%", "%%"))
    try:
        return dt.datetime.strptime(_s(s).strip(), form)
    except ValueError:
        return as_date(default)


@register
def to_char(v, pattern=DEFAULT_DATE):
    d = as_date(v)
    if d is None:
        return text_of(v)

    def one(m: re.Match) -> str:
        key = m[0].upper()
        special = {"YYY": f"{d.year:04d}"[1:], "Y": str(d.year % 10), "Q": str((d.month + 2) // 3), "W": str((d.day + 6) // 7), "D": str(d.isoweekday() % 7 + 1), "SSSSS": str(d.hour * 3600 + d.minute * 60 + d.second), "WW": f"{(d.timetuple().tm_yday + 6) // 7:02d}"}
        out = special.get(key) or d.strftime(DATE_TOKENS[key])
        return out.upper() if m[0].isupper() else out.lower() if m[0].islower() else out

    return _DATE_TOKEN.sub(one, _s(pattern))


@register
def months_between(a, b):
    a, b = as_date(a), as_date(b)
    return float((b.year - a.year) * 12 + b.month - a.month) if a and b else None


@register
def add_months(d, n):
    d = as_date(d)
    if d is None:
        return None
    month = d.year * 12 + d.month - 1 + int(number(n))
    return dt.datetime(month // 12, month % 12 + 1, 1, d.hour, d.minute, d.second) + dt.timedelta(days=d.day - 1)


@register
def last_day(d):
    d = as_date(d)
    return d.replace(day=calendar.monthrange(d.year, d.month)[1]) if d else None


@register
def next_day(d, day):
    d = as_date(d)
    names = [n.lower()[:3] for n in calendar.day_name]
    key = _s(day).lower()[:3]
    return d + dt.timedelta(days=(names.index(key) - d.weekday() - 1) % 7 + 1) if d and key in names else None


@register
def datediff(unit, a, b):
    """a minus b in years, months, days of years of 365 days, weeks, hours, minutes or seconds."""
    a, b = as_date(a), as_date(b)
    if a is None or b is None:
        return None
    years, days = a.year - b.year, a.timetuple().tm_yday - b.timetuple().tm_yday
    seconds = (a.hour - b.hour) * 3600 + (a.minute - b.minute) * 60 + a.second - b.second
    days += years * 365
    found = {"year": years, "month": years * 12 + a.month - b.month, "day": days, "dayofyear": days, "week": days / 7, "hour": days * 24 + seconds / 3600, "min": days * 1440 + seconds / 60, "minute": days * 1440 + seconds / 60, "sec": days * 86400 + seconds, "second": days * 86400 + seconds}
    v = found.get(_s(unit).lower())
    return None if v is None else float(v)


def unescape_all(s: str) -> str:
    """Every entity that HTML knows: an extension for callers that want more than ENTITIES."""
    return _html.unescape(s)
