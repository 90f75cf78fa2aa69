"""Functions of the expression language as Spark columns. Each takes and gives typed columns; see plans.columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.scalar import DATE_TOKENS, DEFAULT_DATE
from fathom.plans.expressions import SyntaxProblem

FUNCTIONS: dict[str, Callable] = {}

SPACES = " \t\n\r\x0b\x0c"

#: The characters that URL encoding leaves and Spark's escapes: fixed values.
URL_KEPT = "~!'(),/=;@:?&$"


def _typed(column: Column, kind: str):
    from fathom.plans.columns import Typed

    return Typed(column, kind)


def text(fn: Callable) -> Callable:
    FUNCTIONS[fn.__name__.rstrip("_")] = lambda *a: _typed(fn(*a), "text")
    return fn


def number(fn: Callable) -> Callable:
    FUNCTIONS[fn.__name__.rstrip("_")] = lambda *a: _typed(fn(*a), "number")
    return fn


def bool_(fn: Callable) -> Callable:
    FUNCTIONS[fn.__name__.rstrip("_")] = lambda *a: _typed(fn(*a), "bool")
    return fn


def date_(fn: Callable) -> Callable:
    FUNCTIONS[fn.__name__.rstrip("_")] = lambda *a: _typed(fn(*a), "date")
    return fn


def _s(x) -> Column:
    return F.coalesce(x.text(), F.lit(""))


def _i(x) -> Column:
    return x.number().cast("int")


@text
def substr(s, start, size=None):
    a = F.greatest(_i(start), F.lit(0)) + 1
    return F.substring(_s(s), a, F.greatest(_i(size), F.lit(0)) if size is not None else F.length(_s(s)))


@text
def ltrim(s, chars=None):
    return F.ltrim(_s(s), F.lit(SPACES) if chars is None else chars.text())


@text
def rtrim(s, chars=None):
    return F.rtrim(_s(s), F.lit(SPACES) if chars is None else chars.text())


@text
def strcat(*args):
    return F.concat(*map(_s, args))


@number
def strcmp(a, b):
    return F.when(_s(a) < _s(b), -1.0).when(_s(a) > _s(b), 1.0).otherwise(0.0)


@number
def strcmpi(a, b):
    x, y = F.lower(_s(a)), F.lower(_s(b))
    return F.when(x < y, -1.0).when(x > y, 1.0).otherwise(0.0)


@text
def replace(s, old=None, new=None):
    return F.replace(_s(s), _s(old), _s(new) if new is not None else F.lit("")) if old is not None else F.lit("")


@text
def lower(s):
    return F.lower(_s(s))


@text
def upper(s):
    return F.upper(_s(s))


@number
def strlen(s):
    return F.octet_length(_s(s)).cast("double")


@number
def strfind(s, what, start=None):
    at = F.position(_s(what), _s(s)) if start is None else F.position(_s(what), _s(s), _i(start) + 1)
    return at.cast("double") - 1


@number
def text_words(s, kind=None, option=None):
    if kind is not None and (kind.value or "").lower() not in ("count", *([""] if kind.literal else [])):
        raise SyntaxProblem("only the count of words has a built-in form")
    return F.regexp_count(_s(s), F.lit(r"[^\x00-\x7F]|[A-Za-z0-9_]+")).cast("double")


@text
def html_encode(s):
    out = F.replace(_s(s), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("\\", "&bslash;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


@text
def html_decode(s):
    """Named entities; numeric ones have no built-in form and stay."""
    out = _s(s)
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&bslash;", "\\"), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


@text
def url_encode(s):
    out = F.url_encode(_s(s))
    for c in URL_KEPT:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


@text
def url_decode(s):
    return F.try_url_decode(_s(s))


@text
def get_email(s, pattern=None):
    if pattern is not None:
        raise SyntaxProblem("addresses by a pattern have no built-in form")
    return F.array_join(F.regexp_extract_all(_s(s), F.lit(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), F.lit(0)), "\n")


@text
def utf8_encode(s):
    return F.decode(F.encode(_s(s), "UTF-8"), "ISO-8859-1")


@text
def packnull(s):
    return F.replace(_s(s), F.lit("\0"), F.lit(""))


@bool_
def ischar(s):
    return _s(s).rlike(r"^\s*[A-Za-z_]")


@bool_
def isnumber(s):
    return _s(s).rlike(r"^\s*[0-9]")


@bool_
def isblank(s):
    return F.trim(_s(s), F.lit(SPACES)) == ""


@bool_
def isphonenumber(s):
    t = F.trim(_s(s), F.lit(SPACES))
    return F.length(t).between(6, 20) & t.rlike(r"^[-+()\d\s./]*\d[-+()\d\s./]*$")


@number
def get_number(s, which=None):
    found = F.regexp_extract_all(_s(s), F.lit(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"), F.lit(0))
    n = F.lit(1) if which is None else F.when(_i(which) == 0, 1).otherwise(_i(which))
    return F.try_element_at(found, n).try_cast("double")


@number
def to_number(s):
    return s.number()


@number
def round_(x):
    whole = (x.number() + 1e-10).cast("long")
    return (whole + F.when(x.number() - whole >= 0.5 - 1e-10, 1).otherwise(0)).cast("double")


@number
def floor(x):
    return (x.number() + 1e-10).cast("long").cast("double")


@number
def ceil(x):
    return (x.number() + 1 - 1e-10).cast("long").cast("double")


@number
def abs_(x):
    return F.abs(x.number())


@number
def rand(*args):
    return F.rand()


@text
def getfilepath(s):
    return F.regexp_extract(_s(s), r"^(.*[/\\\\])?", 1)


@text
def getfilename(s):
    return F.regexp_extract(_s(s), r"([^/\\\\]*)$", 1)


@text
def gethostname(url):
    return F.regexp_extract(_s(url), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)


@text
def getdomainname(url):
    return F.substring_index(F.regexp_extract(_s(url), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), ".", -2)


@text
def getpathname(url):
    return F.regexp_extract(_s(url), r"^(?:[a-zA-Z][\w+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


@date_
def next_day(d, day):
    x = d.date()
    return F.timestamp_seconds(F.unix_timestamp(F.call_function("next_day", x, day.text()).cast("timestamp")) + F.unix_timestamp(x) % 86400)


@date_
def sysdate():
    return F.current_timestamp()


@number
def time_(v=None):
    return F.unix_timestamp(v.date() if v is not None else F.current_timestamp()).cast("double")


@date_
def date(v=None):
    return v.date() if v is not None else F.current_timestamp()


@date_
def to_date(v, pattern=None, default=None):
    if pattern is None:
        return v.date() if default is None else F.coalesce(v.date(), default.date())
    made = F.try_to_timestamp(F.trim(v.text(), F.lit(SPACES)), F.lit(date_pattern(pattern.value)))
    return made if default is None else F.coalesce(made, default.date())


@text
def to_char(v, pattern=None):
    """Tokens in capitals give capitals, tokens in small letters small ones."""
    d, out = v.date(), []
    for token, plain in date_parts(DEFAULT_DATE if pattern is None else pattern.value):
        if token is None:
            out.append(F.lit(plain))
            continue
        c = F.date_format(d, DATE_PATTERNS[token])
        out.append(F.upper(c) if plain.isupper() else F.lower(c) if plain.islower() else c)
    return F.when(d.isNull(), v.text()).otherwise(F.concat(*out) if out else F.lit(""))


@number
def months_between(a, b):
    x, y = a.date(), b.date()
    return ((F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x)).cast("double")


@date_
def add_months(d, n):
    """The day spills over into the next month where a month is too short."""
    x = d.date()
    first = F.add_months(F.trunc(x, "month"), _i(n))
    return F.timestamp_seconds(F.unix_timestamp(first.cast("timestamp")) + (F.dayofmonth(x) - 1) * 86400 + F.unix_timestamp(x) % 86400)


@date_
def last_day(d):
    x = d.date()
    return F.timestamp_seconds(F.unix_timestamp(F.last_day(x).cast("timestamp")) + F.unix_timestamp(x) % 86400)


@number
def datediff(unit, a, b):
    """Years of 365 days, as the language has them."""
    x, y = a.date(), b.date()
    years, seconds = F.year(x) - F.year(y), F.unix_timestamp(x) % 86400 - F.unix_timestamp(y) % 86400
    days = years * 365 + F.dayofyear(x) - F.dayofyear(y)
    u = F.lower(unit.text())
    return (
        F.when(u == "year", years).when(u == "month", years * 12 + F.month(x) - F.month(y)).when(u.isin("day", "dayofyear"), days).when(u == "week", days / 7)
        .when(u == "hour", days * 24 + seconds / 3600).when(u.isin("min", "minute"), days * 1440 + seconds / 60).when(u.isin("sec", "second"), days * 86400 + seconds).cast("double")
    )


#: Date tokens of the language and Spark's patterns for them: fixed values.
DATE_PATTERNS = {"YYYY": "yyyy", "YY": "yy", "MONTH": "MMMM", "MON": "MMM", "MM": "MM", "DDD": "DDD", "DD": "dd", "DAY": "EEEE", "DY": "E", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "AM": "a", "PM": "a", "Q": "q"}


def date_parts(pattern: str | None) -> list[tuple[str | None, str]]:
    """(token in capitals, as written) and (None, the text between tokens) in order. Raises SyntaxProblem for what has no built-in form."""
    if pattern is None:
        raise SyntaxProblem("a date pattern from the data has no built-in form")
    out = []
    for part in re.split(f"({'|'.join(sorted(DATE_TOKENS, key=len, reverse=True))})", pattern, flags=re.I):
        token = part.upper() if part.upper() in DATE_TOKENS else None
        if token is not None and token not in DATE_PATTERNS:
            raise SyntaxProblem(f"{part!r} in a date pattern has no built-in form")
        if part:
            out.append((token, part))
    return out


def date_pattern(pattern: str | None) -> str:
    """Spark's pattern for reading dates: a number that stands alone may have fewer digits."""
    parts, out = date_parts(pattern), []
    for k, (token, plain) in enumerate(parts):
        if token is None:
            out.append("'" + plain.replace("'", "''") + "'")
            continue
        beside = [t for t, _ in parts[max(0, k - 1) : k + 2] if t is not None]
        own = DATE_PATTERNS[token]
        out.append(own[0] if len(beside) == 1 and own in ("MM", "dd", "HH", "hh", "mm", "ss") else own)
    return "".join(out)
