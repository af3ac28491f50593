"""Column builders for text: tokens, shingles, subjects, names, domains, prefixes, HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Consumer mail providers that no firm owns.
FREEMAIL = ["gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "yahoo.com", "icloud.com", "me.com", "aol.com", "proton.me", "protonmail.com", "gmx.com", "mail.com"]


def tokens(c: Column | str) -> Column:
    """Lower-case ASCII words and numbers in order; NULL gives NULL."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def dedupe_key(c: Column | str) -> Column:
    """Text reduced to its ASCII words, for comparing near copies."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def shingles(words: Column, size: int = 5) -> Column:
    """Different runs of ``size`` words; all words as one where there are fewer, none for none."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets given as arrays; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def bare_subject(c: Column | str) -> Column:
    """Subject without reply and forward marks, however often repeated."""
    return F.trim(F.regexp_replace(F.trim(c), r"(?i)^((re|fwd?|fw)\s*:\s*)+", ""))


def subject_key(c: Column | str) -> Column:
    return F.lower(bare_subject(c))


def name_key(c: Column | str) -> Column:
    """Display name in lower case, single blanks, without quotes around it."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(c), "^[\"']+", ""), "[\"']+$", "")
    return F.regexp_replace(F.lower(F.trim(inner)), r"\s+", " ")


def domain_of(c: Column | str) -> Column:
    """Part after the last at-sign, empty for a malformed address."""
    return F.coalesce(F.regexp_extract(c, r"^.+@([^@]+)$", 1), F.lit(""))


def domain_title(c: Column | str) -> Column:
    """The label before the top-level one, its words capitalised."""
    labels = F.filter(F.split(c, r"\."), lambda x: x != "")
    stem = F.when(F.size(labels) >= 2, F.get(labels, F.size(labels) - 2)).otherwise(F.coalesce(F.get(labels, F.lit(0)), c))
    parts = F.filter(F.split(stem, r"[-.]+"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))), " ")


def meta_prefix(kind: Column, sender: Column, to: Column, date: Column, subject: Column, filename: Column | None = None) -> Column:
    """Sentence that says where a chunk comes from; unknown values are left blank."""
    e = lambda c: F.coalesce(c, F.lit(""))
    mail = F.concat(F.lit("Email from "), e(sender), F.lit(" to "), e(to), F.lit(" on "), e(date), F.lit(", subject: "), e(subject), F.lit("."))
    if filename is None:
        return mail
    att = F.concat(F.lit("Attachment "), e(filename), F.lit(" of email from "), e(sender), F.lit(" on "), e(date), F.lit(", subject: "), e(subject), F.lit("."))
    return F.when(kind == "attachment", att).otherwise(mail)


def model_context(reply: Column, fallback: Column) -> Column:
    """A model's reply as context: single blanks, at most 240 characters; empty falls back."""
    clean = F.rtrim(F.substring(F.trim(F.regexp_replace(reply, r"\s+", " ")), 1, 240))
    return F.when(F.coalesce(clean, F.lit("")) == "", fallback).otherwise(clean)


def html_text(c: Column | str) -> Column:
    """Visible text of HTML: no script, style or comment, block ends as line breaks.

    The entities &amp; &lt; &gt; &quot; &apos; &nbsp; (in any case) and numeric ones are decoded, others kept.
    """
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)<\s*(br|/\s*(p|div|tr|li|h[1-6]|table|blockquote))\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    coded = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#(?:x[0-9a-fA-F]{1,6}|[0-9]{1,7});"), F.lit(0)))

    def char(x: Column) -> Column:
        digits = F.regexp_extract(x, r"&#x?([0-9a-fA-F]+);", 1)
        point = F.when(x.startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        # UTF-32 bytes of the code point; surrogates and values beyond Unicode stay as they are
        ok = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise(x)

    t = F.aggregate(coded, t, lambda acc, x: F.replace(acc, x, char(x)))
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        t = F.regexp_replace(t, f"(?i){name}", value)
    t = F.regexp_replace(t, r"[ \t ]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r" *\n *", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def day_distance(later: Column, earlier: Column) -> Column:
    """Days between two ISO instants, as a double."""
    ms = lambda c: F.unix_millis(F.to_timestamp(c))
    return (ms(later) - ms(earlier)) / F.lit(86_400_000.0)


def mime_prefix(c: Column, prefix: Column) -> Column:
    """LIKE prefix match without case."""
    return F.like(F.lower(c), F.concat(F.lower(prefix), F.lit("%")))
