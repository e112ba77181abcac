"""Keys for names and paths that many hands wrote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width forms U+FF01..U+FF5E stand 0xFEE0 above the ASCII characters they show.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def _plain(text: Column) -> Column:
    return F.lower(F.translate(text, _WIDE, _NARROW))


def run_key(name: Column) -> Column:
    """The same text for all spellings of a run: letters' case, separators and leading zeros don't count.

    Separators are all characters but letters and digits; null if none of those is left.
    """
    words = F.regexp_replace(_plain(name), r"[^\p{L}\p{N}]+", " ")
    key = F.regexp_replace(F.trim(words), r"(?<![^ ])0+(?=[0-9])", "")
    return F.when(key != "", key)


def file_key(path: Column) -> Column:
    """The same text for all spellings of a signal file's path, from the output folder on.

    Scheme, drive and mount points before the folder out, the kind of slash, repeated slashes,
    steps '.' and outer white space don't count, nor does the run's spelling in it; null if nothing is left.
    """
    p = F.regexp_replace(F.regexp_replace(_plain(path), r"^[\s ]+|[\s ]+$", ""), r"\\", "/")
    p = F.regexp_replace(p, r"/(\./)+", "/")
    p = F.regexp_replace(p, "/+", "/")
    p = F.regexp_replace(p, r"^(\./)+", "")
    p = F.regexp_replace(p, r"^.*?(?:^|/)out/", "")

    def joined(path: Column) -> Column:
        cut = F.instr(path, "/")
        run = F.substring_index(path, "/", 1)
        key = F.when(cut > 1, F.concat(F.coalesce(run_key(run), run), F.substr(path, cut))).otherwise(path)
        return F.when(key != "", key)

    # A lambda binds the path once; written out, each use would repeat all of the above.
    return F.transform(F.array(p), joined)[0]


def dataset_key(dataset: Column) -> Column:
    """A dataset's name without case and outer blanks; null if blank."""
    key = F.lower(F.regexp_replace(dataset, r"^[\s ]+|[\s ]+$", ""))
    return F.when(key != "", key)


def sql_run_key(column: str) -> str:
    """run_key in SQL."""
    wide, narrow = _WIDE, _NARROW.replace("'", "''")
    words = f"trim(regexp_replace(lower(translate({column}, '{wide}', '{narrow}')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"nullif(regexp_replace({words}, '(^| )0+([0-9])', '\\1\\2', 'g'), '')"


def sql_file_key(column: str) -> str:
    """file_key in SQL."""
    wide, narrow = _WIDE, _NARROW.replace("'", "''")
    p = f"regexp_replace(regexp_replace(lower(translate({column}, '{wide}', '{narrow}')), '^[\\s ]+|[\\s ]+$', '', 'g'), '\\\\', '/', 'g')"
    p = f"regexp_replace(regexp_replace({p}, '/(\\./)+', '/', 'g'), '/+', '/', 'g')"
    p = f"regexp_replace(regexp_replace({p}, '^(\\./)+', ''), '^(?:.*?/)??out/', '')"
    run = f"regexp_extract({p}, '^([^/]+)/', 1)"
    return f"nullif(case when {run} <> '' then coalesce({sql_run_key(run)}, {run}) || '/' || regexp_replace({p}, '^[^/]+/', '') else {p} end, '')"


def sql_dataset_key(column: str) -> str:
    """dataset_key in SQL."""
    return f"nullif(lower(regexp_replace({column}, '^[\\s ]+|[\\s ]+$', '', 'g')), '')"
