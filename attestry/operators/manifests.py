"""What is read from validated manifest stores: cells of the table, time-stamps, validity, status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def manifest_cell(state: Column, remote_url: Column) -> Column:
    """The validation state; "remote" if only a reference is there; else a dash."""
    return F.coalesce(state, F.when(remote_url.isNotNull(), "remote"), F.lit("-"))


def xmp_cell(looked: Column, packets: Column, terms: Column) -> Column:
    """The terms; "present" for packets without any, "none" without packets, "n/a" if the source didn't run."""
    some = F.coalesce(packets, F.lit(0)) > 0
    return F.when(~looked, "n/a").when(some & (F.size(terms) > 0), F.array_join(terms, ",")).when(some, "present").otherwise("none")


def manifest_terms(codes: Column, depth: Column, behind: Column, sep: str = ",") -> Column:
    """The active manifest's codes, and how far back a generative declaration stands."""
    own = F.array_join(codes, sep)
    back = F.concat(F.array_join(behind, sep), F.when(depth == 1, " one step back").otherwise(F.concat(F.lit(" "), depth.cast("string"), F.lit(" steps back"))))
    return F.when(F.coalesce(depth, F.lit(0)) <= 0, own).when(own == "", back).otherwise(F.concat(own, F.lit(" (lineage: "), back, F.lit(")")))


def display_name(path: Column, sha256: Column) -> Column:
    """The file's name, or the first twelve characters of its hash."""
    return F.coalesce(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1), F.substring(sha256, 1, 12))


def truncated(text: Column, width: int) -> Column:
    """At most width characters; of longer texts the end, behind an ellipsis."""
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.lit("…"), F.right(text, F.lit(width - 1))))


def status_codes(buckets: list[Column], prefix: str) -> Column:
    """The distinct codes of all buckets that begin with prefix, sorted."""
    every = F.concat(*[F.coalesce(b, F.array().cast("array<string>")) for b in buckets])
    return F.array_sort(F.array_distinct(F.filter(every, lambda c: F.startswith(c, F.lit(prefix)))))


def time_stamp_status(codes: Column) -> Column:
    """trusted > untrusted > failed (any other code) > validated_only > none."""
    ts = F.filter(codes, lambda c: F.startswith(c, F.lit("timeStamp.")))
    return (
        F.when(F.array_contains(ts, "timeStamp.trusted"), "trusted").when(F.array_contains(ts, "timeStamp.untrusted"), "untrusted")
        .when(F.exists(ts, lambda c: c != "timeStamp.validated"), "failed").when(F.size(ts) == 0, "none").otherwise("validated_only")
    )


def expired_only(failures: Column) -> Column:
    """Whether the certificate expired and nothing else is broken: no mismatch, no failed claim signature."""
    broken = F.exists(failures, lambda c: F.endswith(c, F.lit(".mismatch")) | F.startswith(c, F.lit("claimSignature.")))
    return F.array_contains(failures, "signingCredential.expired") & ~broken


def validity_note(status: Column, not_after: Column, stated: Column) -> Column:
    """What bounds the signature's validity, by the time-stamp's status; null if a trusted time-stamp fixes it."""
    ends = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    other = F.when(stated.isNotNull(), ends(" Under a list that trusts it, the certificate counts as of ", stated, ".")).otherwise("")
    return (
        F.when(status == "none", ends("No time-stamp: a check after ", not_after, " reports the certificate expired."))
        .when(status == "untrusted", ends("The time-stamp's authority is not trusted: a check after ", not_after, " reports the certificate expired.", other))
        .when(status == "failed", ends("The time-stamp did not validate: a check after ", not_after, " reports the certificate expired."))
        .when(status == "validated_only", ends("Nothing is known of the time-stamp's authority: a check after ", not_after, " may report the certificate expired."))
    )


def expired_phrase(status: Column, not_after: Column) -> Column:
    """Why an expired certificate isn't saved by a time-stamp."""
    why = F.when(status == "none", " without a time-stamp").when(status == "untrusted", " with a time-stamp of an untrusted authority").when(status == "failed", " with a time-stamp that did not validate").when(status == "validated_only", " with a time-stamp of an unknown authority").otherwise("")
    return F.concat(F.when(not_after.isNull(), "has expired").otherwise(F.concat(F.lit("has expired (valid until "), not_after, F.lit(")"))), why)


def manifest_status(state: Column, remote_url: Column, parts: Column) -> Column:
    """Trusted is present; valid and invalid are inconclusive, but for an invalid one of a trusted signer whose parts all match; no manifest is absent, unless it is elsewhere."""
    return (
        F.when(state == "Trusted", "present").when((state == "Invalid") & (parts == "match_trusted"), "present").when(state.isNotNull(), "inconclusive")
        .when(remote_url.isNotNull(), "inconclusive").otherwise("absent")
    )
