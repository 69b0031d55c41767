"""The eight commands. Each finds its rows by operators and renders what little it shows."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from .operators import graph, noise, reports
from .operators.build import build_index, build_stats
from .operators.predicates import BOILERPLATE_PARENTS, is_cross_module, parse_patterns
from .operators.resolve import Resolver
from .plans.index import Index, IndexMissing
from .schema import CALLEE_KINDS, TYPE_KINDS
from .sources import noise_conf, providers, semanticdb
from .sources.signatures import display_name

CALL_CAP = graph.CALL_CAP
FOLDER, NAME = ".quillspark", "index"


@dataclass
class Result:
    found: bool
    text: str

    def __str__(self) -> str:
        return self.text


def index_path(given: str | None = None) -> str:
    """Given, else from ``QUILLSPARK_INDEX``, else below the current folder."""
    return given or os.environ.get("QUILLSPARK_INDEX") or os.path.join(FOLDER, NAME)


def _shown(df: DataFrame) -> DataFrame:
    """Located symbols with their display columns."""
    return df.select(
        "symbol_id", "name", "fqn", "kind", "line", "end_line", "type_signature", "owner_id", "properties", "access", "parents", "overridden_symbols", "path", "module_id", "is_test", "is_generated", F.coalesce("owner_name", F.lit("")).alias("owner_name"), "owner_fqn",
        reports.display_kind().alias("display_kind"), reports.property_names().alias("props"), reports.location().alias("loc"), reports.module_display().alias("module"), reports.access_display().alias("access_shown"),
    )


def _tag(module: str) -> str:
    return f" [{module}]" if module else ""


def _line(r: Row) -> str:
    props = f" [{r['props']}]" if r["props"] else ""
    return f"  {r['display_kind']} {r['name']}{props} ({r['path']}{r['loc']})\n    fqn: {r['fqn']}\n"


def _detail(r: Row, verbose: bool = False) -> str:
    props = f" [{r['props']}]" if r["props"] else ""
    out = [f"{r['display_kind']} {r['name']}{props} — {r['path']}{r['loc']}", f"  fqn: {r['fqn']}"]
    if r["type_signature"]:
        out.append(f"  signature: {r['type_signature']}")
    if r["parents"]:
        out.append(f"  parents: {', '.join(r['parents'])}")
    if verbose and r["owner_fqn"]:
        out.append(f"  owner: {r['owner_fqn']}")
    return "\n".join(out) + "\n"


def _missing(resolver: Resolver, query: str) -> Result:
    text = f"Not found: No symbol found matching '{query}'\n"
    rows = resolver.suggestions(query)
    if "fqn" in rows.columns and "display_kind" not in rows.columns and "properties" in rows.columns:
        rows = _shown(rows)
    hints = rows.collect()  # five at most
    if hints:
        text += "Did you mean:\n"
        for r in hints:
            text += f"  {r['display_kind']} {r['name']}\n    fqn: {r['fqn']}\n" if r["fqn"] else f"  {r['name']}\n"
    return Result(False, text)


def source_lines(index: Index, path: str) -> list[str] | None:
    """Lines of a source file of the workspace, if it can be read."""
    try:
        with open(os.path.join(index.workspace_root, path), encoding="utf-8", newline="") as f:
            return f.read().replace("\r\n", "\n").removesuffix("\n").split("\n")
    except (OSError, UnicodeDecodeError):
        return None


def overview(index: Index) -> Result:
    t = reports.totals(index).first()
    out = f"{t['n_modules']} modules, {t['n_symbols']} symbols, {t['n_files']} files\n"
    if t["n_modules"]:
        out += "\nModules:\n" + "".join(f"  {r['module'] or '(unknown)':<50} {r['symbol_count']:>6} symbols  {r['file_count']:>4} files\n" for r in reports.overview(index).collect())
    return Result(True, out)


def search(index: Index, query: str | None = None, limit: int = 50, kind: str | None = None, module: str | None = None, exclude: list[str] | None = None, include_noise: bool = False) -> Result:
    resolver = Resolver(index)
    found = resolver.search(query, kind, module, exclude, include_noise)
    total = found.count()
    if not total:
        return _search_miss(resolver, query, kind, module, exclude, include_noise)
    rows = _shown(found.limit(limit) if limit else found).collect()
    if total == 1:
        return Result(True, _detail(rows[0]))
    label = f"symbols matching '{query}'" if query is not None else "symbols"
    label += f" in module '{module}'" if module else ""
    out = f"{total} {label}\n" + "".join(map(_line, rows))
    if total > len(rows):
        out += f"... and {total - len(rows)} more (use --limit 0 for all)\n"
    return Result(True, out)


def _search_miss(resolver: Resolver, query: str | None, kind: str | None, module: str | None, exclude: list[str] | None, include_noise: bool) -> Result:
    if query is not None and kind:
        other = resolver.other_kinds(query, module, exclude, include_noise)
        total = other.count()
        if total:
            more = f"  ... and {total - 10} more\n" if total > 10 else ""
            return Result(False, f"Not found: No {kind} found matching '{query}'\nFound under other kinds:\n" + "".join(map(_line, _shown(other.limit(10)).collect())) + more)
    if query is None:
        return Result(False, f"Not found: No {kind + ' ' if kind else ''}symbols in module '{module}'\n")
    return _missing(resolver, query)


def _named(index: Index, fqns: list[str]) -> dict[str, str]:
    """Names of full names: the symbol's, else the last part."""
    known = {r["fqn"]: r["name"] for r in index.symbols.where(F.col("fqn").isin(fqns)).select("fqn", "name").collect()} if fqns else {}
    return {f: known.get(f, display_name(f)) for f in fqns}


def _section(title: str, lines: list[str]) -> str:
    return f"  {title}\n" + "".join(f"{x}\n" for x in lines) + "\n" if lines else ""


def info(index: Index, fqn: str, exclude: list[str] | None = None) -> Result:
    """A symbol's profile."""
    resolver = Resolver(index)
    r = _shown(resolver.by_fqn(fqn)).first()
    if r is None:
        return _missing(resolver, fqn)
    sid = r["symbol_id"]
    out = f"{r['display_kind']} {r['name']}{_tag(r['module'])} — {r['path']}{r['loc']}\n  fqn: {r['fqn']}\n"
    counted = reports.count_refs(index.refs.where(F.col("symbol_id") == sid), index.files).first()
    if counted:
        out += f"  referenced: {counted['n_sites']} sites across {counted['n_modules']} modules\n"
    flags = [x for x in ("test", "generated") if r[f"is_{x}"]]
    for title, value in (("source", ", ".join(flags)), ("access", r["access_shown"]), ("properties", r["props"])):
        out += f"  {title}: {value}\n" if value else ""
    out += "\n"
    out += f"  Signature: {r['type_signature']}\n\n" if r["type_signature"] else ""
    located = index.located()
    if r["owner_id"] is not None:
        o = _shown(located.where(F.col("symbol_id") == r["owner_id"])).first()
        out += f"  Owner: {o['display_kind']} {o['name']}\n    fqn: {o['fqn']}\n\n"
    over = list(r["overridden_symbols"])
    names = _named(index, over)
    out += _section(f"Overrides ({len(over)}):", [f"    {names[f]}\n      fqn: {f}" for f in over])
    by = _related(index, "overrides", sid, located)
    out += _section(f"Overridden by ({len(by)}):", [f"    {o['display_kind']} {o['name']} — {o['path']}\n      fqn: {o['fqn']}" for o in by])
    parents = [p for p in r["parents"] if p not in BOILERPLATE_PARENTS]
    names = _named(index, parents)
    out += _section(f"Extends: {', '.join(names[p] for p in parents)}", [f"    fqn: {p}" for p in parents])
    if r["kind"] in TYPE_KINDS:
        rows = reports.members(index).where(F.col("src") == sid)
        order = {x["dst"]: (x["bucket"], x["dst"]) for x in rows.select("dst", "bucket").collect()}
        own = sorted(_shown(rows.withColumnRenamed("dst", "symbol_id")).collect(), key=lambda m: order[m["symbol_id"]])
        out += _section(f"Members ({len(own)}):", [f"    {m['type_signature'] or m['display_kind'] + ' ' + m['name']}\n      fqn: {m['fqn']}" for m in own])
    if r["kind"] in ("trait", "class", "interface"):
        rows = reports.implementations(index).where(F.col("src") == sid).withColumnRenamed("dst", "symbol_id")
        subs = _shown(rows).orderBy("symbol_id").collect()
        out += _section(f"Implementations ({len(subs)}):", [f"    {m['display_kind']} {m['name']} — {m['path']}\n      fqn: {m['fqn']}" for m in subs])
    if r["kind"] in CALLEE_KINDS:
        out += _neighbourhood(index, r, located, exclude)
    return Result(True, out + _body(index, r))


def _related(index: Index, kind: str, sid: int, located: DataFrame) -> list[Row]:
    ids = index.edges_of(kind).where(F.col("src") == sid).select(F.col("dst").alias("symbol_id"))
    return _shown(located.join(ids, "symbol_id", "left_semi")).orderBy("symbol_id").collect()


def _neighbourhood(index: Index, r: Row, located: DataFrame, exclude: list[str] | None) -> str:
    sid, calls = r["symbol_id"], index.edges_of("calls")
    me = index.spark.createDataFrame([(sid,)], "symbol_id long")
    shown = graph.visible(located, exclude)
    ids = {
        "callers": graph.trait_aware_callers(calls, index.edges_of("overrides"), me).select(F.col("caller").alias("symbol_id")),
        "callees": calls.where(F.col("src") == sid).select(F.col("dst").alias("symbol_id")),
    }
    found = {k: _shown(shown.join(v, "symbol_id", "left_semi")).orderBy("symbol_id") for k, v in ids.items()}
    totals = {k: v.count() for k, v in found.items()}
    if not any(totals.values()):
        return ""
    out = "  Call graph (depth 1):\n"
    if totals["callers"]:
        out += f"\n    Callers — who calls this ({totals['callers']}):\n"
        out += "".join(f"      {c['name']}{_tag(c['module'])} — {c['path']}\n        fqn: {c['fqn']}\n" for c in found["callers"].limit(CALL_CAP).collect())
        out += _more(totals["callers"], f"calls '{r['fqn']}' -r")
    if totals["callees"]:
        out += f"\n    Callees — what this calls ({totals['callees']}):\n"
        for k, c in enumerate(found["callees"].limit(CALL_CAP).collect(), 1):
            out += f"      {k}. {_owned(c)}{_tag(c['module']) if _crosses(r, c) else ''}\n         fqn: {c['fqn']}\n"
        out += _more(totals["callees"], f"calls '{r['fqn']}'")
    return out


def _more(total: int, command: str) -> str:
    return f"      ... and {total - CALL_CAP} more (use `{command}` for full list)\n" if total > CALL_CAP else ""


def _owned(r: Row) -> str:
    return f"{r['owner_name']}.{r['name']}" if r["owner_name"] else r["name"]


def _crosses(a: Row, b: Row) -> bool:
    return a["module_id"] is not None and b["module_id"] is not None and a["module_id"] != b["module_id"]


def _bounded(r: Row) -> bool:
    return r["end_line"] is not None and r["end_line"] > r["line"]


def _body(index: Index, r: Row) -> str:
    lines = source_lines(index, r["path"])
    start = r["line"]
    if lines is None or start >= len(lines):
        return ""
    end = min(r["end_line"] + 1 if _bounded(r) else start + 30, len(lines))
    out = "\n  Source:\n" + "".join(f"    {k + 1:>4} | {lines[k]}\n" for k in range(start, end))
    return out + (f"    ... ({len(lines)} total lines in file)\n" if end < len(lines) and not _bounded(r) else "")


def _no_edges(reverse: bool, cross: bool) -> str:
    return f"{'cross-module ' if cross else ''}{'callers' if reverse else 'callees'}"


def _tree(index: Index, root: int, depth: int, exclude: list[str] | None, reverse: bool, cross: bool) -> tuple[list[graph.Visit], dict[int, Row]]:
    edges, rows = graph.fetch(index, root, depth, exclude, reverse, cross, shape=_shown)
    return list(graph.walk(edges, root, depth)), rows


def _mark(root: Row, r: Row) -> str:
    return f"{_tag(r['module'])} — cross-module" if _crosses(root, r) else _tag(r["module"])


def calls(index: Index, fqn: str, depth: int = 3, exclude: list[str] | None = None, reverse: bool = False, cross_module_only: bool = False) -> Result:
    """The call tree below a symbol; repeats are shown but not opened again."""
    resolver = Resolver(index)
    r = _shown(resolver.by_fqn(fqn)).first()
    if r is None:
        return _missing(resolver, fqn)
    visits, rows = _tree(index, r["symbol_id"], depth, exclude, reverse, cross_module_only)
    out = f"{r['name']}{_tag(r['module'])}\n"
    for v in visits:
        out += f"{'│   ' * (v.depth - 1)}{'└── ' if v.last else '├── '}{_owned(rows[v.node])}{_mark(r, rows[v.node])}\n"
    if not any(not v.again for v in visits):
        label = _no_edges(reverse, cross_module_only)
        out += f"(no {label} found for {r['fqn']})\n  resolved to: {r['path']}\n"
        ends = index.edges_of("calls", reverse).select(F.col("src").alias("symbol_id")).distinct()
        others = resolver.filtered(r["name"]).where(F.col("symbol_id") != r["symbol_id"]).join(ends, "symbol_id", "left_semi").orderBy("symbol_id").limit(5).collect()
        if others:
            out += f"  other variants with {label}:\n" + "".join(f"    {o['fqn']} — {o['path']}\n" for o in others)
    return Result(True, out)


def trace(index: Index, fqn: str, depth: int = 3, exclude: list[str] | None = None, reverse: bool = False, cross_module_only: bool = False) -> Result:
    """The call tree with signature and source of each node."""
    resolver = Resolver(index)
    r = _shown(resolver.by_fqn(fqn)).first()
    if r is None:
        return _missing(resolver, fqn)
    visits, rows = _tree(index, r["symbol_id"], depth, exclude, reverse, cross_module_only)
    out = _node(index, r, r, "", "")
    for v in visits:
        before = "│   " * (v.depth - 1)
        head = before + ("└── " if v.last else "├── ")
        if v.again:
            out += f"{head}{_owned(rows[v.node])} (cycle detected)\n"
        else:
            out += _node(index, rows[v.node], r, head, before + ("    " if v.last else "│   "))
    if not any(not v.again for v in visits):
        out += f"(no {_no_edges(reverse, cross_module_only)} found for {r['fqn']} at {r['path']}{r['loc']})\n"
    return Result(True, out)


def _node(index: Index, r: Row, root: Row, head: str, rest: str, most: int = 10) -> str:
    out = f"{head}{r['display_kind']} {_owned(r)}{_mark(root, r)} — {r['path']}{r['loc']}\n{rest}  fqn: {r['fqn']}\n"
    out += f"{rest}  sig: {r['type_signature']}\n" if r["type_signature"] else ""
    lines, start = source_lines(index, r["path"]), r["line"]
    if lines is not None and start < len(lines):
        whole = r["end_line"] + 1 - start if _bounded(r) else None
        end = min(start + min(whole or most, most), len(lines))
        out += "".join(f"{rest}  {k + 1:>4} | {lines[k]}\n" for k in range(start, end))
        if whole is not None and whole > most:
            out += f"{rest}  ... ({whole} lines total, showing first {most})\n"
        elif whole is None and end == start + most and end < len(lines):
            out += f"{rest}  ... (truncated)\n"
    return out + "\n"


def refs(index: Index, fqn: str, limit: int = 100) -> Result:
    """Where a symbol is referred to, by module and file."""
    resolver = Resolver(index)
    r = resolver.by_fqn(fqn).select("symbol_id", "name").first()
    if r is None:
        return _missing(resolver, fqn)
    lines = reports.reference_lines(index.refs.where(F.col("symbol_id") == r["symbol_id"]), index.files)
    t = reports.refs_totals(lines).first()
    if t is None:
        return Result(True, f"{r['name']} — 0 references\n")
    out = f"{r['name']} — {t['n_refs']} references across {t['n_files']} files, {t['n_modules']} modules\n\nBy module:\n"
    label = F.coalesce(F.nullif(reports.module_display("name"), F.lit("")), F.lit("(unknown)")).alias("label")
    names = index.modules.select("module_id", label)
    order = [F.col("module_id").asc_nulls_last()]
    for m in reports.refs_by_module(lines).join(names, "module_id", "left").orderBy(*order).collect():
        out += f"  {m['label'] or '(unknown)':<40} {m['n_refs']} refs in {m['n_files']} files\n"
    out += "\nLocations:\n"
    shown = lines.join(index.files.select("file_id", "path"), "file_id").join(names, "module_id", "left").orderBy(*order, "file_id")
    last = object()
    rows = (shown.limit(limit + 1) if limit else shown).collect()
    for k, f in enumerate(rows):
        if f["module_id"] != last:
            last = f["module_id"]
            out += f"  [{f['label'] or '(unknown)'}]\n"
        if limit and k >= limit:
            break
        out += f"    {f['path']}:{','.join(map(str, f['lines']))}\n"
    if limit and t["n_files"] > limit:
        out += f"  ... and {t['n_files'] - limit} more files (use --limit 0 for all)\n"
    return Result(True, out)


def noise_report(index: Index, limit: int = 15, at: noise.Thresholds = noise.Thresholds()) -> Result:
    found = noise.detect(index, limit, at)
    out = "Noise analysis\n"
    for k, rows in enumerate(found):
        if rows:
            out += f"\n{noise.TITLES[k]}\n"
            for r in rows:
                shown = f"{r['display_kind']:<11} {r['name']}" if k == 1 else f"method {_owned(r) if r['owner_name'] else r['name']}"
                out += f"  {shown:<45} — {noise.evidence(k, r)}\n"
    terms = list(dict.fromkeys(r["pattern"] for rows in found for r in rows))
    if terms:
        out += f'\nSuggested --exclude:\n  --exclude "{",".join(noise.collapse(terms))}"\n'
    return Result(True, out + f"\nConfig: {FOLDER}/{noise_conf.NAME} (edit to customize, `noise --init` to regenerate)\n")


def exclude_patterns(index: Index, folder: str, given: str | None = None, include_noise: bool = False) -> list[str]:
    """Given patterns, then those of the config file; without a file, those that noise detection finds."""
    own = parse_patterns(given)
    if include_noise:
        return own
    known = noise_conf.read(folder)
    if known is None:
        known = [p for _, ps in noise.patterns(noise.detect(index)) for p in ps]
    return own + known


def build(spark: SparkSession, root: str, provider: providers.BuildProvider | None = None, log=sys.stderr) -> str:
    """Index a workspace; returns where the index is. An existing config file stays as it is."""
    root = os.path.realpath(root)
    provider = provider or providers.detect(root)
    files = provider.discover(spark, root)
    metadata = provider.metadata(spark, root, files)
    decoded = semanticdb.read_documents(spark, files).cache()
    failed = semanticdb.failures(decoded)
    if failed:
        print(f"Warning: {failed} .semanticdb file(s) failed to read or parse", file=log)
    docs = semanticdb.good(decoded)
    stats = build_stats(docs).first()
    print(f"Parsed {stats['documents']} documents, {stats['symbols']} symbols, {stats['occurrences']} occurrences", file=log)
    made = build_index(docs, metadata.modules if metadata else None, metadata.rewrites if metadata else None, root)
    folder = os.path.join(root, FOLDER)
    os.makedirs(folder, exist_ok=True)
    path = made.save(os.path.join(folder, NAME))
    decoded.unpersist()
    if noise_conf.read(folder) is None:
        noise_conf.write(folder, noise.patterns(noise.detect(Index.load(spark, path))))
    return path


KINDS = "class trait object method field type constructor case-class enum interface parameter typeparameter package packageobject macro local selfparameter".split()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillspark")
    top.add_argument("--idx", help="path of the index")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("--root", default=".")
    sub.add_parser("overview")
    p = sub.add_parser("search")
    p.add_argument("query", nargs="?")
    p.add_argument("--kind", choices=KINDS)
    p.add_argument("--module")
    p.add_argument("--limit", type=int, default=50)
    for name in ("info", "calls", "trace", "refs"):
        q = sub.add_parser(name)
        q.add_argument("fqn")
        if name in ("calls", "trace"):
            q.add_argument("--depth", type=int, default=3)
            q.add_argument("-r", "--reverse", action="store_true")
            q.add_argument("--cross-module-only", action="store_true")
        if name == "refs":
            q.add_argument("--limit", type=int, default=100)
    for name in ("search", "info", "calls", "trace"):
        sub.choices[name].add_argument("--exclude")
        sub.choices[name].add_argument("--include-noise", action="store_true")
    p = sub.add_parser("noise")
    p.add_argument("--limit", type=int, default=15)
    p.add_argument("--init", action="store_true")
    return top


def run(spark: SparkSession, argv: list[str]) -> str:
    """What a command prints. Missing symbols and a missing index are text too."""
    a = parser().parse_args(argv)
    if a.command == "index":
        return f"Index: {build(spark, a.root)}\n"
    path = index_path(a.idx)
    try:
        index = Index.load(spark, path)
    except IndexMissing as error:
        return f"{error}\n"
    folder = os.path.dirname(os.path.abspath(path))
    if a.command == "overview":
        return str(overview(index))
    if a.command == "refs":
        return str(refs(index, a.fqn, a.limit))
    if a.command == "noise":
        if a.init:
            noise_conf.write(folder, noise.patterns(noise.detect(index, a.limit)))
        return str(noise_report(index, a.limit))
    exclude = exclude_patterns(index, folder, a.exclude, a.include_noise)
    if a.command == "search":
        if a.query is None and a.module is None:
            return "search needs a query or --module\n"
        return str(search(index, a.query, a.limit, a.kind, a.module, exclude, a.include_noise))
    if a.command == "info":
        return str(info(index, a.fqn, exclude))
    command = calls if a.command == "calls" else trace
    return str(command(index, a.fqn, a.depth, exclude, a.reverse, a.cross_module_only))


def main() -> None:
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    sys.stdout.write(run(spark, sys.argv[1:]))


__all__ = ["Result", "build", "calls", "info", "is_cross_module", "noise_report", "overview", "refs", "run", "search", "trace"]

if __name__ == "__main__":
    main()
