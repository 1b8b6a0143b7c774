"""File paths as keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"^[\s ]+|[\s ]+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def canonical_path(path: Column) -> Column:
    """The file a path denotes, as text that is equal for all ways to write it.

    Blanks around it go, %-escapes are decoded (a ``%`` that starts no escape and ``+`` stay), backslashes become
    slashes, repeated slashes and ``.`` steps vanish, ``..`` steps are taken, and a slash at the end goes. Letter case
    and names stay. NULL stays NULL; a blank path gives ''.
    """
    bare = strip(path)
    escaped = F.regexp_replace(F.regexp_replace(bare, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    plain = F.when(F.instr(bare, "%") > 0, F.coalesce(F.try_url_decode(escaped), bare)).otherwise(bare)
    slashed = F.translate(plain, "\\", "/")
    tidy = F.regexp_replace(F.regexp_replace(slashed, r"/(?:\./|/)*", "/"), r"^(?:\./)+|/\.$|(?<=.)/$", "")

    def step(done: Column, name: Column) -> Column:
        up = (name == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != "..")
        return F.when(up, F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(name)))

    rooted = tidy.startswith("/")
    names = F.filter(F.split(tidy, "/"), lambda x: x != "")
    walked = F.array_join(F.aggregate(names, F.array().cast("array<string>"), step), "/")
    walked = F.when(rooted, F.concat(F.lit("/"), F.regexp_replace(walked, r"^(?:\.\./)+|^\.\.$", ""))).otherwise(walked)
    return F.when(tidy.rlike(r"(^|/)\.\.(/|$)"), walked).otherwise(tidy)
