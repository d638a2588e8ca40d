"""Reports of one result (a dictionary of the result's columns) as text and JSON."""

from __future__ import annotations

import json


def _thousands(n: int) -> str:
    return f"{n:,}"


def _by_lines(languages: dict[str, int]) -> list[tuple[str, int]]:
    return sorted(languages.items(), key=lambda x: (-x[1], x[0]))


def _percent(part: int, whole: int) -> int:
    return part * 100 // whole if whole else 0


def _width(r: dict) -> int:
    """Bytes of the longest path, 4 at least, 20 without files."""
    return max([4, *[len(f["file"].encode()) for f in r["file_breakdown"]]]) if r["file_breakdown"] else 20


def stack(r: dict) -> str:
    whole = r["total_loc"]
    out = ["Languages"] + [f"  {n:<12} {_thousands(v):>10}  {_percent(v, whole):>3}%" for n, v in _by_lines(r["languages"])]
    out += ["Frameworks", f"  {'  +  '.join(r['frameworks']) or 'none'}", "Databases", f"  {',  '.join(r['databases']) or 'none'}"]
    return "\n".join(out) + "\n"


def files(r: dict) -> str:
    width = _width(r)
    out = [f"{'File':<{width}}  {'LOC':>10}  Language"] + [f"{f['file']:<{width}}  {_thousands(f['loc']):>10}  {f['language']}" for f in r["file_breakdown"]]
    return "\n".join([*out, f"{'TOTAL':<{width}}  {_thousands(r['total_loc']):>10}"]) + "\n"


def dead_code(r: dict) -> str:
    n = len(r["dead_code"])
    return "\n".join([f"{n} unreachable file{'' if n == 1 else 's'}", *[f"  {p}" for p in r["dead_code"]]]) + "\n"


def usage(framework: str, paths: list[str]) -> str:
    if not paths:
        return f"No files use {framework}. Names are in small letters, such as react, next.js, fastapi, tokio or gin.\n"
    return "\n".join([f"{len(paths)} file{'' if len(paths) == 1 else 's'} using {framework}", *[f"  {p}" for p in paths]]) + "\n"


def full(r: dict) -> str:
    links = sum(map(len, r["dependency_graph"].values()))
    out = ["Summary"] + [
        f"  {k:<18} {_thousands(v)}"
        for k, v in (
            ("Files scanned", len(r["file_breakdown"])), ("Lines of code", r["total_loc"]), ("Languages", len(r["languages"])), ("Frameworks", len(r["frameworks"])),
            ("Databases", len(r["databases"])), ("Infrastructure", len(r["infrastructure"])), ("Dependency links", links), ("Dead files", len(r["dead_code"])),
        )
    ]
    out += ["", "Project Type", f"  {r['project_type']}", "", "Stack", f"  {'  +  '.join(r['frameworks']) or 'none'}"]
    if r["databases"]:
        out += ["", "Databases", f"  {',  '.join(r['databases'])}"]
    if r["infrastructure"]:
        out += ["", "Infrastructure", f"  {'  •  '.join(r['infrastructure'])}"]
    out += ["", "Architecture", f"  {r['architecture']}", "", "Languages"]
    for n, v in _by_lines(r["languages"]):
        pct = _percent(v, r["total_loc"])
        out.append(f"  {n:<12} {'█' * (pct * 28 // 100)}{'░' * (28 - pct * 28 // 100)} {pct:>3}%  {_thousands(v)}")
    out += ["", "Top 5 Files"] + [f"  {k}. {f['file']}  {_thousands(f['loc'])}" for k, f in enumerate(r["file_breakdown"][:5], 1)]
    if r["dead_code"]:
        out += ["", "Dead Code", *[f"  {p}" for p in r["dead_code"]]]
    return "\n".join(out) + "\n"


def as_json(r: dict, compact: bool = False) -> str:
    return json.dumps(r, ensure_ascii=False, **({"separators": (",", ":")} if compact else {"indent": 2}))
