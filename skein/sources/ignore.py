"""Ignore files as a table of rules, applied to a listing by joins.

Each rule has the folder of its ignore file and a key that an entry must have to
be worth a look: its name, its path in the folder, its extension, or any. An
entry (a file, or a folder above one) meets the rules of the folders around it
that share a key with it, so rules and entries are never paired otherwise. The
last rule that fits decides; what lies in an excluded folder is excluded with
it, whatever later rules say.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.session import ship

IGNORE_FILES = (".gitignore", ".ignore")
RULES = "folder string, depth int, source int, line int, excluded boolean, only_folders boolean, key string, pattern string"
_COLUMNS = [c.split()[0] for c in RULES.split(", ")]
_WILD = re.compile(r"[*?\[\\]")


def parse_ignore(folder: str, text: str, source: int = 0) -> list[tuple]:
    """Rules (columns ``RULES``) of one ignore file: globs by line; ``!`` takes back, a slash inside ties to the folder."""
    rules = []
    for number, line in enumerate(text.splitlines()):
        line = line.rstrip() if not line.endswith("\\ ") else line
        if not line or line.startswith("#"):
            continue
        excluded, glob = not line.startswith("!"), line.removeprefix("!")
        body = glob.strip("/")
        if not body:
            continue
        tied = "/" in glob.rstrip("/")
        pattern = f"^{'' if tied else '(?:.*/)?'}{_translated(body)}$"
        rules.append((folder, folder.count("/") + 1 if folder else 0, source, number, excluded, glob.endswith("/"), _key(body, tied), pattern))
    return rules


def _translated(body: str) -> str:
    """A glob as a pattern of paths."""
    parts = []
    for token in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[!?[^\]]+\]|\\.|[^*?\[\\]+|.", body, re.S):
        special = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token)
        if special is None and token[0] == "[" and len(token) > 1:
            special = f"[^/{token[2:]}" if token[1] == "!" else token
        parts.append(special if special is not None else re.escape(token[1:] if token[0] == "\\" and len(token) > 1 else token))
    return "".join(parts)


def _key(body: str, tied: bool) -> str:
    """What an entry must have for the rule to fit: ``n:`` name, ``p:`` path in the folder, ``e:`` extension, ``*`` nothing."""
    if not _WILD.search(body):
        return f"p:{body}" if tied else f"n:{body}"
    last = body.rpartition("/")[2]
    tail = re.search(r"[.][^.*?\[\]\\]+$", last)
    if tail:
        return f"e:{tail[0]}"
    return f"n:{last}" if not _WILD.search(last) else "*"


def _relative(path: Column, root: str) -> Column:
    return F.substring(path, F.lit(len(root) + 2), F.length(path))


def _parts(rel: Column) -> Column:
    return F.split(rel, "/")


def _heads(parts: Column, first: int, last: Column) -> Column:
    """Folders of a path from ``first`` parts to ``last``, as (depth, folder)."""
    counts = F.filter(F.sequence(F.lit(0), F.size(parts)), lambda k: (k >= first) & (k <= last))
    return F.transform(counts, lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("folder")))


def ignore_rules(files: DataFrame, root: str) -> DataFrame:
    """The rules (``RULES``, folders relative to the root) of all ignore files in folders of ``files`` (path), read in parallel."""
    spark: SparkSession = files.sparkSession
    ship(spark)
    root = root.rstrip("/")
    plain = re.sub(r"^file:/+", "/", root)
    parts = _parts(_relative(F.col("path"), plain))
    folders = files.select(F.explode(_heads(parts, 0, F.size(parts) - 1)).alias("f")).select("f.folder").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, where = fs.FileSystem.from_uri(root)
        for batch in batches:
            names = [(folder, source, "/".join(x for x in (where, folder, name) if x)) for folder in batch["folder"] for source, name in enumerate(IGNORE_FILES)]
            found = []
            for (folder, source, name), info in zip(names, store.get_file_info([n for *_, n in names]), strict=True):
                if info.type == fs.FileType.File:
                    with store.open_input_stream(name, compression=None) as stream:
                        found += parse_ignore(folder, stream.read().decode("utf-8", "replace"), source)
            yield pd.DataFrame(found, columns=_COLUMNS)

    return folders.mapInPandas(run, RULES)


def kept(files: DataFrame, rules: DataFrame, root: str) -> DataFrame:
    """The rows of ``files`` (path) that the rules leave in."""
    plain = re.sub(r"^file:/+", "/", root.rstrip("/"))
    rel = _relative(F.col("path"), plain)
    listed = files.select("path").distinct().select("path", rel.alias("rel"))
    parts = _parts(F.col("rel"))
    folders = listed.select(F.explode(_heads(parts, 1, F.size(parts) - 1)).alias("f")).select(F.col("f.folder").alias("rel"), F.lit(True).alias("is_folder")).distinct()
    entries = folders.unionByName(listed.select("rel", F.lit(False).alias("is_folder")))
    name = F.element_at(parts, -1)
    extension = F.when(F.contains(name, F.lit(".")), F.concat(F.lit("e:."), F.substring_index(name, ".", -1)))
    below = F.transform(_heads(parts, 0, F.size(parts) - 1), lambda h: F.struct(h["folder"].alias("folder"), F.array_join(F.slice(parts, h["depth"] + 1, F.size(parts)), "/").alias("sub")))
    asked = entries.select("rel", "is_folder", F.concat(F.lit("n:"), name).alias("named"), extension.alias("extension"), F.explode(below).alias("b"))
    keys = F.array_compact(F.array(F.col("named"), F.col("extension"), F.concat(F.lit("p:"), F.col("b.sub")), F.lit("*")))
    asked = asked.select("rel", "is_folder", "b.folder", "b.sub", F.explode(keys).alias("key"))
    fits = (~F.col("only_folders") | F.col("is_folder")) & F.rlike("sub", F.col("pattern"))
    last = F.max_by("excluded", F.struct("depth", "source", "line"))
    verdict = asked.join(rules, ["folder", "key"]).where(fits).groupBy("rel", "is_folder").agg(last.alias("excluded"))
    gone = verdict.where("excluded").select("rel", "is_folder")
    # A file goes by its own verdict or by that of any folder around it.
    around = listed.select("path", F.explode(_heads(parts, 1, F.size(parts))).alias("h"), parts.alias("parts")).select("path", F.col("h.folder").alias("rel"), (F.col("h.depth") < F.size("parts")).alias("is_folder"))
    out = around.join(gone, ["rel", "is_folder"], "left_semi").select("path").distinct()
    return files.join(out, "path", "left_anti")
