"""Command line: init, index, update, search, stats, completions."""

from __future__ import annotations

import argparse
import logging
import os
import signal
import sys

COMMANDS = {
    "init": ["--force"],
    "index": ["--path", "--quick", "--full", "--force"],
    "update": ["--path"],
    "search": ["--path", "-n", "--author", "--after", "--before", "--file", "--exact", "--ef", "--mode", "--diverse", "--lambda", "--json"],
    "stats": ["--path"],
    "completions": [],
}
SHELLS = ("bash", "zsh", "fish", "elvish", "powershell")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone", description="Hybrid search over a repository's history.")
    p.add_argument("--model-path", help="folder with model.onnx and tokenizer.json")
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init", help="check the embedder").add_argument("--force", action="store_true")
    c = sub.add_parser("index", help="index the history")
    c.add_argument("-p", "--path", default=".")
    group = c.add_mutually_exclusive_group()
    group.add_argument("--quick", action="store_true", help="messages only")
    group.add_argument("--full", action="store_true", help="with changes (the default)")
    c.add_argument("--force", action="store_true", help="from scratch")
    sub.add_parser("update", help="the same as index").add_argument("-p", "--path", default=".")
    c = sub.add_parser("search", help="search the history")
    c.add_argument("query")
    c.add_argument("-p", "--path", default=".")
    c.add_argument("-n", "--number", type=int, default=10)
    for name in ("author", "after", "before", "file"):
        c.add_argument(f"--{name}")
    c.add_argument("--exact", action="store_true")
    c.add_argument("--ef", type=int)
    c.add_argument("--mode", choices=("hybrid", "semantic", "lexical"), default="hybrid")
    c.add_argument("--diverse", action="store_true")
    c.add_argument("--lambda", dest="weight", type=float, default=0.7)
    c.add_argument("--json", action="store_true")
    sub.add_parser("stats", help="about the index").add_argument("-p", "--path", default=".")
    sub.add_parser("completions", help="a script for the shell").add_argument("shell", choices=SHELLS)
    return p


def completions(shell: str) -> str:
    words = " ".join(COMMANDS)
    if shell == "bash":
        cases = "\n".join(f"    {c}) COMPREPLY=($(compgen -W '{' '.join(o)}' -- \"$cur\"));;" for c, o in COMMANDS.items())
        return f"_lodestone() {{\n  local cur=${{COMP_WORDS[COMP_CWORD]}}\n  case ${{COMP_WORDS[1]}} in\n{cases}\n    *) COMPREPLY=($(compgen -W '{words}' -- \"$cur\"));;\n  esac\n}}\ncomplete -F _lodestone lodestone"
    options = {c: " ".join(o) for c, o in COMMANDS.items()}
    if shell == "zsh":
        cases = "\n".join(f"    {c}) compadd -- {o};;" for c, o in options.items() if o)
        return f"#compdef lodestone\n_lodestone() {{\n  if (( CURRENT == 2 )); then compadd -- {words}; return; fi\n  case ${{words[2]}} in\n{cases}\n  esac\n}}\n_lodestone \"$@\""
    if shell == "fish":
        lines = [f"complete -c lodestone -n __fish_use_subcommand -a {c}" for c in COMMANDS]
        flags = lambda o: f"-l {o[2:]}" if o.startswith("--") else f"-s {o[1:]}"
        return "\n".join(lines + [f"complete -c lodestone -n '__fish_seen_subcommand_from {c}' {flags(o)}" for c, os_ in COMMANDS.items() for o in os_])
    if shell == "elvish":
        cases = " ".join(f"&{c}=[{o}]" for c, o in options.items())
        return f"set edit:completion:arg-completer[lodestone] = {{|@a| var o = [{cases}]; if (and (> (count $a) 2) (has-key $o $a[1])) {{ put $@o[$a[1]] }} else {{ put {words} }} }}"
    items = ", ".join(f"'{c}'" for c in COMMANDS)
    cases = "; ".join(f"'{c}' = @({', '.join(repr(x) for x in o)})" for c, o in COMMANDS.items())
    return f"Register-ArgumentCompleter -Native -CommandName lodestone -ScriptBlock {{ param($w, $line) $o = @{{ {cases} }}; $c = \"$line\".Split(' ')[1]; $all = if ($o.ContainsKey($c) -and $c -ne $w) {{ $o[$c] }} else {{ @({items}) }}; $all | Where-Object {{ $_ -like \"$w*\" }} }}"


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lodestone").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", os.environ.get("LODESTONE_PARTITIONS", "8")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _engine(args):
    from lodestone.embed import EmbeddingConfig, HashedEmbedder, OnnxEmbedder
    from lodestone.plans.engine import Engine
    from lodestone.sources.git import git_dir

    embedder = OnnxEmbedder(EmbeddingConfig(path=args.model_path)) if args.model_path else HashedEmbedder()
    return Engine(_session(), os.path.join(git_dir(args.path), "lodestone-index"), embedder)


def run(args) -> int:
    """Results go to stdout, all else to stderr."""
    say = lambda *x: print(*x, file=sys.stderr)
    if args.command == "completions":
        print(completions(args.shell))
        return 0
    if args.command == "init":
        from lodestone.embed import EmbeddingConfig, HashedEmbedder, OnnxEmbedder

        embedder = OnnxEmbedder(EmbeddingConfig(path=args.model_path)) if args.model_path else HashedEmbedder()
        if args.force:
            embedder.forget()
        embedder.validate()
        say("ready")
        return 0
    engine = _engine(args)
    if args.command in ("index", "update"):
        meta, done = engine.index_repository(args.path, getattr(args, "quick", False), getattr(args, "full", False), getattr(args, "force", False))
        if done == "refused":
            say("the index has no changes in it; use --full --force to index them")
        say(f"{done}: {meta.total_commits} commits, last {meta.last_commit[:7]}")
    elif args.command == "stats":
        row = engine.stats().first().asDict()
        for k, v in row.items():
            print(f"{k}: {v:.2f}" if isinstance(v, float) else f"{k}: {v}")
    else:
        from lodestone.operators.filters import SearchFilters
        from lodestone.output import json_document, text_lines
        from lodestone.plans.engine import SearchRequest
        from lodestone.plans.planner import Mode

        filters = SearchFilters(args.author, args.after, args.before, args.file)
        filters.predicate()
        if not engine.storage.exists():
            say("no index yet; indexing with changes")
            engine.index_repository(args.path, full=True)
        o = engine.search(SearchRequest(args.query, args.number, filters, Mode(args.mode), args.exact, args.ef, args.diverse, args.weight))
        if args.json:
            print(json_document(o.results, args.query, o.mode.value, o.strategy.value, o.candidates, o.diversified, round(o.took_ms, 3)).first().json)
        else:
            lines = text_lines(o.results)
            print("\n".join(lines) if lines else "no results")
            print(f"{o.mode.value}, {o.strategy.value}, {o.candidates} candidates, {o.took_ms:.0f} ms")
    return 0


def main(argv: list[str] | None = None) -> int:
    from lodestone.errors import LodestoneError

    if hasattr(signal, "SIGPIPE"):
        signal.signal(signal.SIGPIPE, signal.SIG_DFL)
    args = parser().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO if args.verbose else logging.WARNING)
    try:
        return run(args)
    except LodestoneError as e:
        print(e.report(), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
