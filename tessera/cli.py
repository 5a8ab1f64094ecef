"""Command line: python -m tessera.cli list|info|download|parse|process|init|clean|cache-dir ..."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from tessera.errors import TesseraError
from tessera.operators import intel, syntax
from tessera.operators.catalog import ALIASES, Catalog, builtin, download_plan, load_markdown
from tessera.operators.process import ProcessConfig, process_text, resolve
from tessera.schemas import FAMILIES
from tessera.sources import config as pack


def _catalog(path: str | None) -> Catalog:
    return load_markdown(Path(path).read_text(encoding="utf-8").splitlines()) if path else builtin()


def _language(path: str, given: str | None, catalog: Catalog) -> str:
    """The language given, else that of the path; standard input needs one given."""
    if given:
        return resolve(given, frozenset(catalog.extensions))
    name = Path(path).name
    ext = name.rpartition(".")[2] if "." in name.lstrip(".") else ""
    found = catalog.by_extension.get(ext.lower()) if path != "-" else None
    if not found:
        raise TesseraError("no language found; give one with --language")
    return found


def _read(path: str) -> str:
    data = sys.stdin.buffer.read() if path == "-" else Path(path).read_bytes()
    return data.decode("utf-8")


def process_config(args: argparse.Namespace) -> ProcessConfig:
    """Any explicit flag replaces the defaults; all turns the families on."""
    on = [f for f in FAMILIES if getattr(args, f)]
    config = ProcessConfig().all() if args.all else ProcessConfig(**(dict.fromkeys(("structure", "imports", "exports"), False) | dict.fromkeys(on, True))) if on else ProcessConfig()
    return config.with_chunking(args.chunk_size) if args.chunk_size is not None else config


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("--catalog", help="a Markdown table of languages and extensions")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("parse", "process"):
        c = commands.add_parser(name)
        c.add_argument("path")
        c.add_argument("--language")
    c = commands.choices["parse"]
    c.add_argument("--format", choices=("sexp", "json"), default="sexp")
    c = commands.choices["process"]
    c.add_argument("--all", action="store_true")
    c.add_argument("--chunk-size", type=int)
    for f in FAMILIES:
        c.add_argument(f"--{f}", action="store_true")
    c = commands.add_parser("list")
    c.add_argument("--filter", default="")
    commands.add_parser("info").add_argument("name")
    c = commands.add_parser("download")
    c.add_argument("names", nargs="*", default=[])
    c.add_argument("--all", action="store_true")
    c.add_argument("--groups", nargs="*", default=[])
    c.add_argument("--config")
    c.add_argument("--fresh", action="store_true")
    c = commands.add_parser("init")
    c.add_argument("--languages", nargs="*", default=[])
    c.add_argument("--groups", nargs="*", default=[])
    c.add_argument("--cache-dir")
    commands.add_parser("clean")
    commands.add_parser("cache-dir")
    args = parser.parse_args(argv)
    cache = os.environ.get("TESSERA_CACHE", str(Path.home() / ".cache" / "tessera"))
    try:
        catalog = _catalog(args.catalog)
        if args.command == "list":
            print("\n".join(n for n in sorted(catalog.extensions) if args.filter in n))
        elif args.command == "info":
            to = ALIASES.get(args.name, args.name)
            known = to in catalog.extensions
            print(json.dumps({"name": args.name, "known": known, "backend": known and syntax.has_backend(to), "cache_dir": cache}))
        elif args.command == "download":
            config = pack.load(args.config) if args.config else pack.discover()
            if args.fresh:
                pack.clean_cache(cache)
            print("\n".join(download_plan(catalog, args.all, tuple(args.groups), tuple(args.names), config)))
        elif args.command == "init":
            pack.write(pack.FILE, pack.PackConfig(args.cache_dir, args.languages, args.groups))
        elif args.command == "clean":
            print(pack.clean_cache(cache))
        elif args.command == "cache-dir":
            print(cache)
        else:
            language, text = _language(args.path, args.language, catalog), _read(args.path)
            if args.command == "process":
                print(json.dumps({"language": language} | process_text(text, language, process_config(args)), indent=2, ensure_ascii=False))
            else:
                nodes = syntax.parse(text, language)
                sexp = intel.to_sexp(nodes)
                print(sexp if args.format == "sexp" else json.dumps({"language": language, "sexp": sexp, "has_errors": any(n.error or n.missing for n in nodes)}))
    except (TesseraError, OSError, UnicodeDecodeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
