"""Column expressions: clocks, links, words, small text rules, array shapes. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clock_ms(text: Column) -> Column:
    """``1:02:03`` as milliseconds."""
    return F.aggregate(F.split(text, ":"), F.lit(0).cast("long"), lambda a, p: a * 60 + p.cast("long")) * 1000


def clock_text(ms: Column) -> Column:
    """``m:ss`` of milliseconds, floored, not below 0; empty for null."""
    s = F.greatest(F.floor(ms / 1000), F.lit(0))
    return F.when(ms.isNull(), "").otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0")))


def stamp_ms(text: Column) -> Column:
    """``m:ss.fff``: no fraction, tenths, hundredths or thousandths (more digits are cut); seconds below 60, else null."""
    part = lambda i: F.regexp_extract(text, r"^([0-9]+):([0-9]{1,2})(?:[.:]([0-9]*))?$", i)
    fraction = F.rpad(F.substring(part(3), 1, 3), 3, "0").cast("long")
    return F.when((part(1) != "") & (part(2).cast("int") < 60), part(1).cast("long") * 60000 + part(2).cast("long") * 1000 + F.coalesce(fraction, F.lit(0)))


def words(text: Column) -> Column:
    """Lower-case runs of letters and numbers of any script."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")


def within_one_edit(a: Column, b: Column) -> Column:
    """One insertion, deletion, substitution or swap of neighbours at most."""
    n = F.length(a)
    at = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    swapped = F.exists(at, lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b)
    return (F.levenshtein(a, b) <= 1) | ((n == F.length(b)) & (n > 1) & swapped)


def plain(markup: Column) -> Column:
    """Without tags; the five basic character references decoded."""
    out = F.regexp_replace(markup, "<[^>]*>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def host(url: Column) -> Column:
    """Lower-case host without a closing dot."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"\.$", "")


def link_verdict(url: Column, extractable: list[str], streaming: list[str]) -> Column:
    """``audio file`` by the path's ending, else by host: ``extractable``, ``streaming`` or ``unsupported``."""
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1))
    of = lambda hosts: F.array(*[F.lit(h) for h in hosts])
    h = host(url)
    ends = lambda hosts: F.exists(of(hosts), lambda x: (h == x) | h.endswith(F.concat(F.lit("."), x)))
    return F.when(path.rlike(r"\.(mp3|m4a|wav|flac|ogg|opus|aac)$"), "audio file").when(ends(extractable), "extractable").when(ends(streaming), "streaming").otherwise("unsupported")


def spread_words(text: Column, start: Column, end: Column) -> Column:
    """Words with even slots of 1 to 600 ms from the start: (text, start_ms, end_ms)."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    length = lambda p: F.greatest(F.least(F.floor((end - start) / F.greatest(F.size(p), F.lit(1))), F.lit(600)), F.lit(1)).cast("long")
    slots = lambda p, n: F.transform(p, lambda w, i: F.struct(w.alias("text"), (start + i * n).alias("start_ms"), (start + (i + 1) * n).alias("end_ms")))
    # a lambda's own variables are computed once; an outer expression in it, once for each word
    return F.transform(F.array(parts), lambda p: F.transform(F.array(length(p)), lambda n: slots(p, n))[0])[0]


def interleave(left: Column, right: Column) -> Column:
    """l0, r0, l1, r1, ...; the shorter side ends it."""
    n = F.least(F.size(left), F.size(right))
    return F.flatten(F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), lambda a, b: F.array(a, b)))


def nearest_rank(values: Column, share: float) -> Column:
    """sorted[round((n - 1) * share)], halves away from zero; values as a list."""
    ordered = F.array_sort(values)
    return F.try_element_at(ordered, (F.round((F.size(ordered) - 1) * F.lit(share)) + 1).cast("int"))


def decibels(power: Column) -> Column:
    """10 log10(power + 1e-10)."""
    return 10 * F.log10(power + 1e-10)


def mean_square(values: Column) -> Column:
    """Mean of squares of an array, in double precision; null for an empty one."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.try_divide(total, F.size(values))


def loudness(peak: Column) -> Column:
    """20 log10 of the peak, -50 to 0 dB as 0 to 1."""
    return F.greatest(F.least((20 * F.log10(F.greatest(peak, F.lit(1e-6))) + 50) / 50, F.lit(1.0)), F.lit(0.0))


def chunk_count(frames: Column, size: int) -> Column:
    return F.ceil(frames / size)


def decode_window(chunk: Column, total: Column, before: int = 1, after: int = 3) -> tuple[Column, Column]:
    """First and last chunk to hold around the current one."""
    return F.greatest(chunk - before, F.lit(0)), F.least(chunk + after, total - 1)
