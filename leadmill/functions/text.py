"""Column functions on strings."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: The same, as it is sought in a text: a run of signs that no @ follows is passed over at once, not anew from each of its signs.
EMAILS = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: What tells a placeholder address, as the reference lists it. Fixed values.
PLACEHOLDER = r"test@test|@test\.|noreply|no-reply|placeholder|dummy@|@dummy"
#: Ways to write the signs of an address. Fixed values.
SIGNS = {"@": r"(?i)＠|&#0*64;|&#x0*40;|&commat;| ?[\[(（]at[\])）] ?", ".": r"(?i)．|&#0*46;|&#x0*2e;|&period;| ?[\[(（]dot[\])）] ?"}


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with value worked out once, however often of uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def listed(words: list[str]) -> Column:
    """Words as one array; Spark works it out once."""
    return F.split(F.lit("\x1f".join(words)), "\x1f")


def any_of(words: list[str]) -> str:
    """A pattern of any of the words, in their order; where no word begins, one look tells."""
    firsts = "".join(sorted({re.escape(w[0]) for w in words}))
    return f"(?=[{firsts}])(?:" + "|".join(map(re.escape, words)) + ")"


def visible_text(html: Column) -> Column:
    """Text outside scripts, styles and tags, with single spaces."""
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?is)<noscript[^>]*>.*?</noscript>", r"(?s)<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    return F.trim(F.regexp_replace(html, r"[ \t\r\n]+", " "))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match, null if none."""
    return bound(F.regexp_extract(text, pattern, group), lambda x: F.when(x != "", x))


def plain_signs(text: Column) -> Column:
    """Full-width signs, entities and obfuscated signs of addresses to @ and dots."""
    plain = lambda t: reduce(lambda x, s: F.regexp_replace(x, SIGNS[s], s), SIGNS, t)
    return bound(text, lambda t: F.when(t.rlike(r"[＠．&\])）](?:(?<=[＠．])|(?<=&)[#cpCP]|(?<=[tT].))"), plain(t)).otherwise(t))  # most texts hold none


def normalised_email(address: Column) -> Column:
    """Plain signs; mailto:, query, brackets and titles dropped; leading digits and phone numbers cut; lower case.

    The reference also cuts up to the last '+' of the local part, which gives another address; that is kept here.
    """
    usual = r"^[A-Za-z][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\z"
    return bound(F.trim(address), lambda a: F.when(a.rlike(usual), F.lower(a)).otherwise(unusual_email(a)))


def unusual_email(address: Column) -> Column:
    out = plain_signs(address)
    for pattern in (r"(?i)^mailto:", r"\?.*$", r"[（）()]", r"代表|担当|事務局"):
        out = F.regexp_replace(out, pattern, "")
    own = lambda a: F.coalesce(extract(a, r"[A-Za-z][A-Za-z0-9._%+-]*$", 0), extract(a, r"[\p{L}\p{N}._%+-]+(?=[^\p{L}\p{N}._%+-]*$)", 0), a)
    local = lambda o: bound(F.substring_index(o, "@", 1), own)
    return bound(out, lambda o: F.when(F.contains(o, F.lit("@")), F.lower(F.concat(local(o), F.lit("@"), F.regexp_replace(o, r"^[^@]*@", "")))))


def valid_email(address: Column) -> Column:
    return address.rlike(f"^{EMAIL}$") & (F.length(address) > 5) & ~address.rlike(PLACEHOLDER)


def formatted_phone(phone: Column) -> Column:
    """Japanese grouping by the number of digits: 10 as 2-4-4, 11 as 3-4-4, 11 or 12 behind country code 81, other 12 as 4-4-4, more in
    fours from the end; shorter ones stay as they are."""
    digits = F.regexp_replace(phone, r"[^0-9]", "")
    n = F.length(digits)
    part = lambda text, a, k=1 << 30: F.substring(text, a, k)
    grouped = lambda text, *sizes: F.concat_ws("-", *[part(text, 1 + sum(sizes[:k]), sizes[k]) for k in range(len(sizes))])
    local = part(digits, 3)
    last = F.regexp_replace(digits, r"^([0-9]*?)([0-9]{4})([0-9]{4})$", "$1-$2-$3")
    return (
        F.when(n == 10, grouped(digits, 2, 4, 4)).when(n == 11, grouped(digits, 3, 4, 4)).when(digits.startswith("81") & (n == 12), F.concat(F.lit("0"), grouped(local, 1, 4, 5)))
        .when(n == 12, grouped(digits, 4, 4, 4)).when(n > 12, last).otherwise(phone)
    )


JAPANESE = r"[぀-ヿ一-龯]"


def formatted_address(address: Column) -> Column:
    low = F.lower(F.trim(address))
    return F.when(low.rlike(f"^{EMAIL}$"), low).otherwise(F.replace(low, F.lit(" "), F.lit("")))


def formatted_person(name: Column) -> Column:
    """Single spaces; a name without Japanese letters in capitals of words."""
    bare = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.when(bare.rlike(JAPANESE), bare).otherwise(F.initcap(bare))


def formatted_company(name: Column) -> Column:
    """As a person's name, but with legal abbreviations in capitals."""
    bare = F.trim(F.regexp_replace(name, r"\s+", " "))
    words = F.transform(F.split(bare, " "), lambda w: F.when(F.upper(w).isin("LLC", "INC", "LTD", "CORP", "CO"), F.upper(w)).otherwise(F.initcap(w)))
    return F.when(bare.rlike(JAPANESE), bare).otherwise(F.array_join(words, " "))


def formatted_message(text: Column) -> Column:
    """Line feeds alone, two in a row at most, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
