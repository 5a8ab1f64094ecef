"""Language catalogue: a dimension table of names, aliases and extensions, and the registry's questions as DataFrame operators.

The built-in rows cover common languages. A larger catalogue is a parameter: load_markdown() reads a table of display names and
extensions, load_table() any DataFrame with (name, extensions).
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.errors import DownloadError, LanguageNotFoundError
from tessera.operators.syntax import has_backend

#: Aliases, resolved in one hop.
ALIASES = {"bazel": "starlark", "gradle": "groovy", "ignorefile": "gitignore", "lisp": "commonlisp", "makefile": "make", "shell": "bash"}
#: Display names whose canonical name is not their lower-case form.
CANONICAL = {"Cap'n Proto": "capnp", "Emacs Lisp": "elisp", "F#": "fsharp", "Protocol Buffers": "proto", "QML": "qmljs", "reStructuredText": "rst"}
#: Names whose grammar symbol differs.
C_SYMBOLS = {"csharp": "c_sharp", "embeddedtemplate": "embedded_template", "nushell": "nu", "vb": "vb_dotnet"}
#: Group names; their members are not public data and come from the user.
GROUPS = ("web", "systems", "scripting", "data", "jvm", "functional")
#: Built-in languages and their extensions.
BUILTIN = {
    "ada": "ada adb ads",
    "asm": "asm s",
    "bash": "sh bash zsh",
    "c": "c h",
    "clojure": "clj cljs cljc edn",
    "cmake": "cmake",
    "commonlisp": "lisp lsp cl",
    "cpp": "cpp cc cxx hpp hxx hh",
    "csharp": "cs",
    "css": "css",
    "csv": "csv",
    "cue": "cue",
    "d": "d",
    "dart": "dart",
    "diff": "diff patch",
    "dockerfile": "dockerfile",
    "dtd": "dtd",
    "editorconfig": "editorconfig",
    "elisp": "el",
    "elixir": "ex exs",
    "elm": "elm",
    "erlang": "erl hrl",
    "fortran": "f90 f95 f03 f08",
    "fsharp": "fs fsx",
    "gitignore": "gitignore",
    "go": "go",
    "graphql": "graphql gql",
    "groovy": "groovy gradle",
    "haskell": "hs",
    "hcl": "hcl",
    "hocon": "hocon",
    "html": "html htm",
    "ini": "ini",
    "java": "java",
    "javascript": "js mjs cjs jsx",
    "json": "json",
    "json5": "json5",
    "julia": "jl",
    "kdl": "kdl",
    "kotlin": "kt kts",
    "latex": "tex sty",
    "lua": "lua",
    "make": "mk",
    "markdown": "md markdown",
    "nginx": "nginx",
    "nim": "nim",
    "nix": "nix",
    "objc": "m",
    "ocaml": "ml",
    "pascal": "pas",
    "perl": "pl pm",
    "php": "php",
    "po": "po pot",
    "powershell": "ps1 psm1",
    "properties": "properties",
    "proto": "proto",
    "psv": "psv",
    "python": "py pyi pyw",
    "r": "r",
    "rst": "rst",
    "ruby": "rb",
    "rust": "rs",
    "scala": "scala",
    "scheme": "scm ss",
    "scss": "scss",
    "solidity": "sol",
    "sql": "sql",
    "starlark": "bzl star",
    "svelte": "svelte",
    "swift": "swift",
    "terraform": "tf tfvars",
    "toml": "toml",
    "tsv": "tsv",
    "tsx": "tsx",
    "typescript": "ts mts cts",
    "vim": "vim",
    "vue": "vue",
    "xml": "xml svg xsd xsl",
    "yaml": "yaml yml",
    "zig": "zig",
}
#: How far the syntax backends go; those not named here work on brackets, words and line ends alone.
FIDELITY = {
    "exact": ("json", "csv", "psv", "xml"),
    "good": ("python", "html", "properties", "ini", "editorconfig", "po", "toml", "dtd", "yaml", "json5", "hjson", "hcl", "hocon", "kdl", "cue", "nginx", "caddy"),
}


def canonical_name(display: str) -> str:
    return CANONICAL.get(display, display.lower().replace(" ", "_"))


@dataclass(frozen=True)
class Catalog:
    """Languages with their extensions; groups are members by group name."""

    extensions: dict[str, tuple[str, ...]]
    groups: dict[str, tuple[str, ...]] | None = None

    @property
    def by_extension(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for name, own in self.extensions.items():
            for e in own:
                out.setdefault(e.lower(), name)
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """(name, alias_of, extensions, backend, fidelity), aliases whose target is there included."""
        level = {n: f for f, names in FIDELITY.items() for n in names}
        about = lambda n: ("builtin", level.get(n, "heuristic")) if has_backend(n) else (None, "catalogue")
        rows = [(n, None, list(e), *about(n)) for n, e in self.extensions.items()]
        rows += [(a, t, [], *about(t)) for a, t in ALIASES.items() if t in self.extensions]
        return spark.createDataFrame(rows, "name string, alias_of string, extensions array<string>, backend string, fidelity string")


def builtin() -> Catalog:
    return Catalog({n: tuple(e.split()) for n, e in BUILTIN.items()})


def load_markdown(lines: Iterable[str]) -> Catalog:
    """A catalogue from the rows `| Display name | `.ext`, ... | ...` of a Markdown table."""
    out = {}
    for line in lines:
        cells = [c.strip() for c in line.strip().strip("|").split("|")]
        if line.lstrip().startswith("|") and len(cells) > 1 and cells[0] != "Language" and not set(cells[0]) <= set("-: "):
            out[canonical_name(cells[0])] = tuple(re.findall(r"`\.([^`]+)`", cells[1]))
    return Catalog(out)


def load_table(rows: DataFrame) -> Catalog:
    """A catalogue from (name, extensions array); a catalogue is a small dimension table."""
    return Catalog({r.name: tuple(r.extensions or ()) for r in rows.select("name", "extensions").collect()})


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(pairs.items()) for x in pair])


def resolve_alias(name: Column) -> Column:
    return F.coalesce(F.element_at(_literal_map(ALIASES), name), name)


def c_symbol_for(name: Column) -> Column:
    return F.coalesce(F.element_at(_literal_map(C_SYMBOLS), name), name)


def name_for_symbol(symbol: Column) -> Column:
    return F.coalesce(F.element_at(_literal_map({v: k for k, v in C_SYMBOLS.items()}), symbol), symbol)


def available_languages(languages: DataFrame) -> DataFrame:
    """Sorted names, and those aliases whose target is among them."""
    names = languages.where("alias_of is null").select("name")
    aliases = languages.sparkSession.createDataFrame(sorted(ALIASES.items()), "name string, target string")
    present = aliases.join(names.withColumnRenamed("name", "target"), "target", "left_semi").select("name")
    return names.union(present).distinct().orderBy("name")


def language_count(languages: DataFrame) -> DataFrame:
    return available_languages(languages).agg(F.count("*").alias("languages"))


def has_language(asked: DataFrame, languages: DataFrame, name: str = "name") -> DataFrame:
    """asked with known (its name, or what that is an alias of, is in the catalogue)."""
    known = languages.where("alias_of is null").select(F.col("name").alias("_known")).distinct()
    return asked.withColumn("_to", resolve_alias(F.col(name))).join(known, F.col("_to") == F.col("_known"), "left").withColumn("known", F.col("_known").isNotNull()).drop("_to", "_known")


def has_parser(asked: DataFrame, languages: DataFrame, name: str = "name") -> DataFrame:
    """asked with has_parser: a syntax backend is built in for it."""
    able = languages.where("alias_of is null and backend is not null").select(F.col("name").alias("_able")).distinct()
    return asked.withColumn("_to", resolve_alias(F.col(name))).join(able, F.col("_to") == F.col("_able"), "left").withColumn("has_parser", F.col("_able").isNotNull()).drop("_to", "_able")


def list_filter(languages: DataFrame, part: str) -> DataFrame:
    return available_languages(languages).where(F.contains(F.col("name"), F.lit(part)))


def complete(languages: DataFrame, prefix: str, limit: int = 100) -> DataFrame:
    """Names with the prefix, at most `limit`, with the total and whether there are more."""
    found = available_languages(languages).where(F.startswith(F.col("name"), F.lit(prefix)))
    counted = found.withColumn("total", F.count("*").over(Window.partitionBy(F.lit(1))))
    return counted.orderBy("name").limit(limit).withColumn("has_more", F.col("total") > limit)


def info(languages: DataFrame, name: str, cache_dir: str = "") -> DataFrame:
    """One row: (name, known, downloaded, cache_dir). Backends ship with the library, so what has one is downloaded."""
    asked = languages.sparkSession.createDataFrame([(name,)], "name string")
    return has_parser(has_language(asked, languages), languages).select("name", "known", F.col("has_parser").alias("downloaded"), F.lit(cache_dir).alias("cache_dir"))


def language_of(name: Column, catalog: Catalog | None = None) -> Column:
    """The canonical name of a language, null for one that the catalogue has not."""
    known = {n: n for n in (catalog or builtin()).extensions}
    return F.element_at(_literal_map(known), resolve_alias(name))


def downloaded_languages(languages: DataFrame) -> DataFrame:
    return languages.where("alias_of is null and backend is not null").select("name").orderBy("name")


def manifest_languages(languages: DataFrame) -> DataFrame:
    return languages.where("alias_of is null").select("name").orderBy("name")


def require(languages: DataFrame, names: list[str]) -> int:
    """The number of unique names asked for; an unknown one raises, no names are 0."""
    if not names:
        return 0
    asked = languages.sparkSession.createDataFrame([(n,) for n in names], "name string").distinct()
    unknown = [r.name for r in has_language(asked, languages).where(~F.col("known")).select("name").orderBy("name").collect()]
    if unknown:
        raise DownloadError(f"not in the catalogue: {', '.join(unknown)}")
    return len(set(names))


def require_group(catalog: Catalog, group: str) -> int:
    """All languages there are, once every member of the group is known."""
    members = (catalog.groups or {}).get(group)
    if members is None:
        raise DownloadError(f"no such group: {group}")
    unknown = sorted(set(members) - set(catalog.extensions))
    if unknown:
        raise DownloadError(f"not in the catalogue: {', '.join(unknown)}")
    return len(catalog.extensions)


def download_plan(catalog: Catalog, everything: bool = False, groups: tuple[str, ...] = (), languages: tuple[str, ...] = (), config=None) -> list[str]:
    """Canonical names, sorted: all there are, else the groups' members, else the languages given, else those of a configuration
    (its languages, then its groups' members). An unknown name or group raises."""
    if everything:
        return sorted(catalog.extensions)
    if not groups and not languages and config is not None:
        languages, groups = tuple(config.languages), tuple(config.groups)
        if languages and groups:
            return sorted({*download_plan(catalog, languages=languages), *download_plan(catalog, groups=groups)})
    if groups:
        for g in groups:
            require_group(catalog, g)
        return sorted({m for g in groups for m in (catalog.groups or {})[g]})
    return sorted({get_language(catalog, n) for n in languages})


def prefetch(spark: SparkSession, catalog: Catalog, names: list[str]) -> int:
    """Loads the backends of the languages on every core, by a task each; the number of unique names asked for."""
    to = sorted({get_language(catalog, n) for n in names})
    cores = spark.sparkContext.defaultParallelism

    def warm(batches):
        import pyarrow as pa

        from tessera.operators.syntax import parse

        for batch in batches:
            for name in to:
                parse("", name)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["id"])

    if to:
        spark.range(cores, numPartitions=cores).mapInArrow(warm, "id long").count()
    return len(set(names))


def get_language(catalog: Catalog, name: str) -> str:
    """The canonical name; an unknown or empty one raises."""
    to = ALIASES.get(name, name)
    if to not in catalog.extensions:
        raise LanguageNotFoundError(f"language not found: {name!r}")
    return to
