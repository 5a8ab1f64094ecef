"""Language detection as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.operators.catalog import Catalog, builtin

#: Interpreters of shebang lines.
INTERPRETERS = {
    "python": "python",
    "bash": "bash",
    "sh": "bash",
    "dash": "bash",
    "ash": "bash",
    "zsh": "bash",
    "node": "javascript",
    "nodejs": "javascript",
    "ruby": "ruby",
    "jruby": "ruby",
    "perl": "perl",
    "lua": "lua",
    "php": "php",
    "elixir": "elixir",
    "julia": "julia",
    "Rscript": "r",
    "r": "r",
    "R": "r",
}
#: Suffixes of more than one part.
COMPOUND = {".app.src": "erlang"}
MAX_EXTENSION = 32


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in sorted(pairs.items()) for x in pair]), key)


def from_extension(ext: Column, catalog: Catalog | None = None) -> Column:
    """The language of an extension without its dot: ASCII, at most 32 bytes, in any case."""
    ok = (F.octet_length(ext) <= MAX_EXTENSION) & (F.octet_length(ext) == F.length(ext))
    return F.when(ok, _lookup((catalog or builtin()).by_extension, F.lower(ext)))


def file_name(path: Column) -> Column:
    """The last component of a path, null where that is none or `..`."""
    name = F.regexp_extract(F.regexp_replace(path, r"(/\.?)+$", ""), r"([^/]*)$", 1)
    return F.when(~name.isin("", ".", ".."), name)


def from_path(path: Column, catalog: Catalog | None = None) -> Column:
    """The language of a path by its compound suffix, else by its last extension; a dotfile has none."""
    name = file_name(path)
    out = from_extension(F.nullif(F.regexp_extract(name, r"^.+\.([^.]*)$", 1), F.lit("")), catalog)
    for suffix, language in COMPOUND.items():
        out = F.when(F.endswith(F.lower(name), F.lit(suffix)), F.lit(language)).otherwise(out)
    return out


def detect(path: Column, catalog: Catalog | None = None) -> Column:
    """from_path(), else the whole string as an extension, leading dots aside."""
    return F.coalesce(from_path(path, catalog), from_extension(F.ltrim(path, F.lit(".")), catalog))


def from_content(text: Column) -> Column:
    """The language of a shebang line: the program, or the first argument of env that is no flag, without its version."""
    line = F.when(F.startswith(text, F.lit("#!")), F.substring_index(F.substr(text, F.lit(3)), "\n", 1))
    words = F.filter(F.split(line, r"[ \t\n\f\r]+"), lambda w: w != "")
    first = F.try_element_at(words, F.lit(1))
    env = (first == "env") | F.endswith(first, F.lit("/env"))
    program = F.when(env, F.try_element_at(F.filter(F.slice(words, 2, 1 << 30), lambda w: ~F.startswith(w, F.lit("-"))), F.lit(1))).otherwise(F.substring_index(first, "/", -1))
    # Of env only leading flags are passed over, and the word after them counts, even if it is an assignment.
    return _lookup(INTERPRETERS, F.regexp_replace(program, r"(?s)\.?[0-9].*$", ""))


def combined(path: Column, text: Column, catalog: Catalog | None = None) -> Column:
    return F.coalesce(from_path(path, catalog), from_content(text))


def ambiguity(ext: Column, alternatives: dict[str, list[str]]) -> Column:
    """The other languages of an extension, from a table that the user has; null for an extension not in it."""
    pairs = [x for k, v in sorted(alternatives.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.element_at(F.create_map(*pairs), F.lower(ext)) if pairs else F.lit(None).cast("array<string>")


def register(spark: SparkSession, catalog: Catalog | None = None) -> None:
    """The lookup table of extensions as the view tessera_extensions, for SQL users to join."""
    rows = sorted((catalog or builtin()).by_extension.items())
    spark.createDataFrame(rows, "extension string, language string").createOrReplaceTempView("tessera_extensions")
