"""Version order as a string: keys that compare as versions do.

A key is made of the epoch and the numbers of a release, each as two digits for its length and then its digits, without
the zeros at the end of the release. What follows a release sorts before, at or after it by one character: ``!`` and the
identifiers of a pre-release, ``#`` for the release itself, ``$`` and the number of a post-release. All three sort
before the digits of a further number, so 1.0-rc.1 < 1.0 = 1.0.0 < 1.0.post1 < 1.0.1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A key below and one above those of all versions.
LOWEST, HIGHEST = "", "~"
#: Labels of pre-releases in Python's order, and what they count as.
LABELS = {"dev": "", "a": "alpha", "alpha": "alpha", "b": "beta", "beta": "beta", "c": "rc", "rc": "rc", "pre": "rc", "preview": "rc"}


def _number(digits: Column) -> Column:
    bare = F.regexp_replace(F.when(digits == "", "0").otherwise(digits), r"^0+(?=\d)", "")
    return F.concat(F.lpad(F.length(bare).cast("string"), 2, "0"), bare)


def _identifiers(text: Column) -> Column:
    """Identifiers between dots: numbers in their order before words in theirs, fewer before more."""
    return F.array_join(
        F.transform(F.split(text, r"\."), lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("0"), _number(x))).otherwise(F.concat(F.lit("1"), x, F.lit(" ")))),
        "",
    )


def version_key(version: Column, ecosystem: Column) -> Column:
    """The key of a version; null where it does not begin with a number (after ``v`` or ``=``).

    Case, blanks around and build metadata (from a plus sign on) do not count. Versions of PyPI follow Python's rules
    (epochs, a/b/rc/dev labels with or without separators, post-releases), others those of semantic versions.
    """
    text = F.regexp_replace(F.regexp_replace(F.lower(F.trim(version)), r"^[v=\s]+", ""), r"\+.*$", "")
    python = F.lower(ecosystem) == "pypi"
    epoch = F.regexp_extract(text, r"^(\d+)!", 1)
    rest = F.regexp_replace(text, r"^\d+!", "")
    release = F.regexp_extract(rest, r"^(\d+(?:\.\d+)*)", 1)
    tail = F.substring(rest, F.length(release) + 1, F.length(rest))
    numbers = F.array_join(F.transform(F.split(F.regexp_replace(release, r"(?:\.0+)+$", ""), r"\."), _number), "")
    post = r"^[._-]?(?:post|rev|r)[._-]?(\d*)$"
    label = r"^[._-]?(" + "|".join(sorted(LABELS, key=len, reverse=True)) + r")[._-]?(\d*)(.*)$"
    word = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[F.regexp_extract(tail, label, 1)]
    after = (
        F.when(tail == "", "#")
        .when(python & tail.rlike(post), F.concat(F.lit("$"), _number(F.regexp_extract(tail, post, 1))))
        .when(python & tail.rlike(label), F.concat(F.lit("!1"), word, F.lit(" 0"), _number(F.regexp_extract(tail, label, 2)), F.regexp_extract(tail, label, 3)))
        .otherwise(F.concat(F.lit("!"), _identifiers(F.regexp_replace(tail, r"^[.-]", ""))))
    )
    return F.when(release != "", F.concat(_number(epoch), numbers, after))
