"""Reports as text. Only bounded reports come to the driver; everything else is written by Spark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from codeloom.functions import code

# fixed values
LABELS = {"function_added": "Function added", "function_removed": "Function removed", "signature_changed": "Signature changed", "class_modified": "Class modified", "function_modified": "Function modified"}
REPORT_ROWS = 1000
OUTPUT_TOKENS = 8000


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def metrics_rows(summary: DataFrame) -> DataFrame:
    """One wide row as (metric, value) rows."""
    return summary.select(F.expr("stack({}, {}) AS (metric, value)".format(len(summary.columns), ", ".join(f"'{c}', cast({c} AS string)" for c in summary.columns))))


def impact_report(totals: DataFrame, changed: DataFrame, style: str = "plain") -> str:
    """Totals and the first changed symbols (REPORT_ROWS at most, by risk and name) as plain text, Markdown or JSON; says how many it leaves out."""
    t = totals.first().asDict()
    rows = [r.asDict() for r in changed.orderBy(F.desc(code.risk_rank(F.col("risk_level"))), "name").limit(REPORT_ROWS).select("name", "change_type", "risk_level", "references", "breaking").collect()]
    more = (t.get("changes") or 0) - len(rows)
    if style == "json":
        return json.dumps({"totals": t, "symbols": rows, "left_out": max(more, 0)}, indent=2, ensure_ascii=False)
    lines = [f"{k}: {v}" for k, v in t.items()]
    if style == "markdown":
        body = [f"- **{r['name']}** {LABELS.get(r['change_type'], r['change_type'])} ({r['risk_level']}, {r['references']} references)" for r in rows]
        out = ["## Change impact", "", *[f"- {x}" for x in lines], "", "### Symbols", "", *body]
    else:
        out = ["Change impact", *lines, *[f"{r['risk_level']:>6} {r['name']} {r['change_type']} {r['references']}" for r in rows]]
    return "\n".join(out + ([f"... and {more} more"] if more > 0 else []))


def comment(totals: DataFrame, changed: DataFrame, top: DataFrame, untouched: DataFrame) -> str:
    """A Markdown comment on a change: totals, a section for each kind of change with each symbol's first references (impact.top_references), and files that are affected without being changed. REPORT_ROWS symbols at most, by risk and name; says how many it leaves out."""
    t = totals.first().asDict()
    rows = changed.orderBy(F.desc(code.risk_rank(F.col("risk_level"))), "name", "path").limit(REPORT_ROWS).select("name", "path", "change_type", "risk_level", "references", "breaking")
    refs: dict[tuple, list] = {}
    for r in top.join(F.broadcast(rows.select("name", F.col("path").alias("symbol_file"))), ["name", "symbol_file"], "left_semi").orderBy("name", "symbol_file", "rank").collect():
        refs.setdefault((r["name"], r["symbol_file"]), []).append(r)
    got = rows.collect()
    out = ["## Change impact", "", f"**{t['changes']}** changes, **{t['breaking']}** breaking, **{t['references']}** references, overall risk **{t['overall_risk']}**"]
    for kind in sorted({r["change_type"] for r in got}):
        out += ["", f"### {LABELS.get(kind, kind)}", ""]
        for r in (r for r in got if r["change_type"] == kind):
            out.append(f"- `{r['name']}` in `{_short(r['path'])}` ({r['risk_level']}{', breaking' if r['breaking'] else ''}, {r['references']} references)")
            mine = refs.get((r["name"], r["path"]), [])
            out += [f"  - `{_short(x['file'])}` ({x['usage_type']}, {x['n']})" for x in mine]
            out += [f"  - ... and {mine[0]['more']} more"] if mine and mine[0]["more"] else []
    more = t["changes"] - len(got)
    out += [f"... and {more} more symbols"] if more > 0 else []
    files = [r[0] for r in untouched.select("path").collect()]
    return "\n".join(out + (["", "### Affected without being changed", "", *[f"- `{_short(f)}`" for f in files]] if files else []))


def _short(path: str | None) -> str:
    return (path or "").replace("src/src/", "src/")


def stats_text(summary: DataFrame, languages: DataFrame) -> str:
    s = summary.first().asDict()
    return "\n".join([*(f"{k}: {v}" for k, v in s.items()), "languages:", *(f"  {r[0]}: {r[1]}" for r in languages.orderBy("language").select("language", "files").limit(REPORT_ROWS).collect())])


def guarded(text: str, limit: int = OUTPUT_TOKENS, force: bool = False) -> str:
    """The text, or where it would take more tokens (a quarter of its characters) its head and a note."""
    n = len(text) // 4
    return text if force or n <= limit else text[: limit * 4] + f"\n[cut: about {n} tokens, {limit} allowed]"
