"""Dependency graphs: import resolution, edges, reachability, cycles, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeloom.functions import code
from codeloom.session import Stage

# fixed values: endings tried for an import without one, in order of preference
TRY_JS = ["", ".js", ".ts", ".jsx", ".tsx", ".mjs", "/index.js", "/index.ts"]
TRY_PY = [".py", "/__init__.py"]


def candidates(imports: DataFrame) -> DataFrame:
    """imports (repo, path, language, module) → (repo, path, module, target, preference): the paths a module may stand for."""
    here = code.parent_dir(F.col("path"))
    m = F.col("module")
    join = lambda base, rest: code.normal_path(F.concat_ws("/", base, rest))
    rel_js = F.transform(F.array(*map(F.lit, TRY_JS)), lambda e: F.concat(join(here, m), e))
    dotted = F.translate(F.regexp_replace(m, r"^\.+", ""), ".", "/")
    py = F.concat(F.transform(F.array(*map(F.lit, TRY_PY)), lambda e: F.concat(dotted, e)), F.transform(F.array(*map(F.lit, TRY_PY)), lambda e: F.concat(join(here, dotted), e)))
    c = F.array(join(here, m), m)
    go = F.array(join(here, m))
    rust = F.transform(F.array(F.lit(".rs"), F.lit("/mod.rs")), lambda e: F.concat(F.lit("src/"), F.replace(F.regexp_replace(F.regexp_replace(m, r"^(?:crate|super)::", ""), r"::(?:\{.*|\w+)$", ""), F.lit("::"), F.lit("/")), e))
    cs = F.array(F.concat(F.translate(m, ".", "/"), F.lit(".cs")))
    lang = F.col("language")
    none = F.array().cast("array<string>")
    paths = (
        F.when(lang.isin("javascript", "typescript") & m.startswith("."), rel_js)
        .when(lang == "python", py)
        .when(lang.isin("c", "cpp"), c)
        .when((lang == "go") & m.startswith("./"), go)
        .when((lang == "rust") & m.rlike(r"^(?:crate|super)::"), rust)
        .when((lang == "csharp") & ~m.startswith("System"), cs)
        .otherwise(none)
    )
    return imports.select("repo", "path", "module", F.posexplode(paths).alias("preference", "target"))


def edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, src, dst): each import resolved to the file of the same repo that its first existing candidate names; the rest has no edge."""
    hit = candidates(imports).join(files.select("repo", F.col("path").alias("target")).distinct(), ["repo", "target"])
    best = hit.groupBy("repo", "path", "module").agg(F.min_by("target", "preference").alias("dst"))
    return best.select("repo", F.col("path").alias("src"), "dst").distinct()


def degrees(edge: DataFrame) -> DataFrame:
    """(repo, path, includes, included_by, hotspot)."""
    both = edge.select("repo", F.col("src").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edge.select("repo", F.col("dst").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("repo", "path").agg(F.sum("o").alias("includes"), F.sum("i").alias("included_by")).withColumn("hotspot", F.col("includes") * F.col("included_by"))


def reachable(edge: DataFrame, starts: DataFrame | None = None, backwards: bool = False) -> DataFrame:
    """(repo, start, node, distance): every node below each start (every source by default), by breadth-first steps over the pairs found last. A node on a cycle reaches itself. The result is as large as the answer."""
    e = edge.select("repo", F.col("dst").alias("a"), F.col("src").alias("b")) if backwards else edge.select("repo", F.col("src").alias("a"), F.col("dst").alias("b"))
    st = Stage(edge.sparkSession, "reach")
    e = st.put(e.distinct())
    first = e if starts is None else e.join(starts.select("repo", F.col("path").alias("a")).distinct(), ["repo", "a"], "left_semi")
    found = front = st.put(first.select("repo", F.col("a").alias("start"), F.col("b").alias("node"), F.lit(1).alias("distance")))
    k = 1
    while not front.isEmpty():
        k += 1
        step = front.join(e.withColumnRenamed("a", "node"), ["repo", "node"]).select("repo", "start", F.col("b").alias("node")).distinct()
        front = st.put(step.join(found.select("repo", "start", "node"), ["repo", "start", "node"], "left_anti").withColumn("distance", F.lit(k)).select("repo", "start", "node", "distance"))
        found = st.put(found.unionByName(front))
    return found


def _trimmed(st: Stage, e: DataFrame) -> DataFrame:
    """Edges whose ends have both predecessors and successors, until none falls away: all that can lie on cycles."""
    n = e.count()
    while n:
        ins, outs = e.select("repo", F.col("dst").alias("v")).distinct(), e.select("repo", F.col("src").alias("v")).distinct()
        both = ins.join(outs, ["repo", "v"], "left_semi")
        new = st.put(e.join(both.withColumnRenamed("v", "src"), ["repo", "src"], "left_semi").join(both.withColumnRenamed("v", "dst"), ["repo", "dst"], "left_semi").select("repo", "src", "dst"))
        st.drop(e)
        e, m = new, new.count()
        if m == n:
            break
        n = m
    return e


def cycles(edge: DataFrame) -> DataFrame:
    """(repo, component, path): files on cycles (self-imports included), with the smallest path of their strongly connected component.

    Colouring: every node takes the smallest node that reaches it; what reaches that node within its colour is its
    component. Components leave the graph and the rest is coloured again. Work per step is linear in the edges left; no closure is built.
    """
    st = Stage(edge.sparkSession, "cycles")
    e = st.put(edge.where("src IS NOT NULL AND dst IS NOT NULL").select("repo", "src", "dst").distinct())
    found = None
    loops = e.where("src = dst").select("repo", F.col("src").alias("component"), F.col("src").alias("path"))
    e = _trimmed(st, e.where("src <> dst"))
    while not e.isEmpty():
        color = st.put(e.select("repo", F.explode(F.array("src", "dst")).alias("v")).distinct().withColumn("c", F.col("v")))
        changed = True
        while changed:
            push = e.join(color.withColumnRenamed("v", "src"), ["repo", "src"]).groupBy("repo", F.col("dst").alias("v")).agg(F.min("c").alias("c2"))
            new = st.put(color.join(push, ["repo", "v"], "left").select("repo", "v", F.least("c", F.coalesce("c2", "c")).alias("c"), (F.coalesce(F.col("c2"), F.col("c")) < F.col("c")).alias("moved")))
            changed = not new.where("moved").isEmpty()
            st.drop(color)
            color = new
        inside = e.join(color.select("repo", F.col("v").alias("src"), F.col("c").alias("cs")), ["repo", "src"]).join(color.select("repo", F.col("v").alias("dst"), F.col("c").alias("cd")), ["repo", "dst"]).where("cs = cd")
        inside = st.put(inside.select("repo", "src", "dst", F.col("cs").alias("c")))
        got = front = st.put(color.where("v = c").select("repo", "c", "v"))
        while not front.isEmpty():
            back = inside.join(front.withColumnRenamed("v", "dst"), ["repo", "c", "dst"]).select("repo", "c", F.col("src").alias("v")).distinct()
            front = st.put(back.join(got, ["repo", "c", "v"], "left_anti").select("repo", "c", "v"))
            got = st.put(got.unionByName(front))
        size = got.groupBy("repo", "c").agg(F.count("*").alias("n")).where("n > 1").select("repo", "c")
        part = got.join(size, ["repo", "c"], "left_semi").select("repo", F.col("c").alias("component"), F.col("v").alias("path"))
        found = part if found is None else found.unionByName(part)
        rest = e.join(got.select("repo", F.col("v").alias("src")), ["repo", "src"], "left_anti").join(got.select("repo", F.col("v").alias("dst")), ["repo", "dst"], "left_anti")
        e = _trimmed(st, st.put(rest.select("repo", "src", "dst")))
    if found is None:
        return loops
    return found.unionByName(loops.join(found.select("repo", "path"), ["repo", "path"], "left_anti").select("repo", "component", "path"))


def as_text(edge: DataFrame, style: str = "dot") -> DataFrame:
    """One text line per edge of a drawing language; the caller adds head and tail."""
    form = {"dot": '  "%s" -> "%s";', "mermaid": "  %s --> %s"}
    if style == "json":
        return edge.select("repo", F.to_json(F.struct("src", "dst")).alias("line"))
    safe = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')) if style == "dot" else F.regexp_replace(c, r"[^\w./-]", "_")
    return edge.select("repo", F.format_string(form[style], safe(F.col("src")), safe(F.col("dst"))).alias("line"))
