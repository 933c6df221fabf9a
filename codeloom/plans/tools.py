"""The six tools as DataFrames: status, trace, search, graph, modules, tests. ``render`` makes text of their first rows.

A tool on an empty table raises NotLoaded, but for the call graph's, which says so in its rendering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import constants as C
from codeloom.functions.predicates import holds, is_optimizer, module_groups, word_match
from codeloom.functions.text import excerpt, location, relative_path, truncate
from codeloom.operators import graph as G
from codeloom.operators import match as M
from codeloom.operators.ranking import best_tier, dedupe_first, top_k_with_total
from codeloom.plans.render import formatter

ORDER = ["file_path", "ord"]


class NotLoaded(RuntimeError):
    pass


class Catalog:
    """Tables by name, with the tools as methods."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], source: str | None = None):
        self.spark, self.tables, self.source = spark, tables, source

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def need(self, *names: str) -> None:
        for n in names:
            if n not in self.tables or self.tables[n].isEmpty():
                raise NotLoaded(f"{n} is empty; build the catalog first")

    def _query(self, *names: str) -> DataFrame:
        return self.spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("query"))

    # ------------------------------------------------------------ status

    def status(self) -> DataFrame:
        """component, item, n: sizes of all tables, and the five most frequent dispatch keys."""
        one = lambda part, item, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("component"), F.lit(item).alias("item"), "n")
        t = self.tables
        keys = t["bindings"].where("dispatch_key <> ''").groupBy("dispatch_key").agg(F.count(F.lit(1)).alias("n"))
        top = keys.orderBy(F.desc("n"), "dispatch_key").limit(5)
        rows = [
            one("bindings", "bindings", t["bindings"]), one("bindings", "cuda_kernels", t["cuda_kernels"]), one("bindings", "dispatch_keys", keys),
            top.select(F.lit("dispatch").alias("component"), F.col("dispatch_key").alias("item"), "n"),
            one("operators", "native_functions", t["native_functions"]), one("operators", "derivatives", t["derivatives"]), one("operators", "implementations", t["native_implementations"]),
            one("call_graph", "functions", G.vertices(t["call_edges"], t["function_locations"])), one("call_graph", "edges", t["call_edges"]), one("call_graph", "files", t["function_locations"].select("file").distinct()),
            one("python", "modules", t["py_modules"]), one("python", "classes", t["py_classes"]), one("python", "nn_modules", t["py_classes"].where("is_module")),
            one("tests", "files", t["test_files"]), one("tests", "classes", t["test_classes"].select("name").distinct()), one("tests", "functions", t["test_functions"].select("name").distinct()), one("tests", "opinfo", t["opinfo_registry"]),
        ]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    # ------------------------------------------------------------ trace

    def definition(self, name: str) -> DataFrame:
        """The operator's row and its derivative formulas (of the name itself, else of its base); no row if there is no such operator."""
        found = M.native_lookup(self._query(name), self["native_functions"]).select("lookup_name")
        row = self["native_functions"].join(F.broadcast(found), "lookup_name")  # one row
        deriv = self["derivatives"].select(F.col("name").alias("d_name"), "gradients")
        own = deriv.where(F.col("d_name") == name).select(F.col("gradients").alias("own"))
        base = deriv.select(F.col("d_name").alias("base_name"), F.col("gradients").alias("of_base"))
        short = lambda g: F.transform_values(g, lambda k, v: truncate(v, C.FORMULA_WIDTH))
        row = row.join(base, "base_name", "left").join(F.broadcast(own), how="left") if not own.isEmpty() else row.join(base, "base_name", "left").withColumn("own", F.lit(None).cast("map<string,string>"))
        return row.select("name", "base_name", "signature", "dispatch", "variants", "structured", "structured_delegate", "tags", short(F.coalesce("own", "of_base")).alias("gradients"))

    def registrations(self, name: str, k: int = 20) -> DataFrame:
        """dispatch_key, cpp_name, file_path, line, rank, total: bindings of the Python name, else of the C++ name, else of the nearest one."""
        rows = self["bindings"]
        tier = F.when(F.col("python_name") == name, 0).when(F.col("cpp_name") == name, 1)
        found = best_tier(rows.withColumn("tier", tier).where("tier is not null").withColumn("q", F.lit(name)), ["q"], "tier")
        if found.isEmpty():
            names = rows.where("python_name <> ''").groupBy(F.col("python_name").alias("name")).agg(F.min(F.struct("file_path", "ord")).alias("ord"))
            near = M.fuzzy_find(self._query(name), names).select(F.col("name").alias("python_name"))
            found = rows.join(F.broadcast(near), "python_name")
        found = dedupe_first(found.select("dispatch_key", "cpp_name", "file_path", "line", "ord"), ["dispatch_key", "cpp_name", "file_path"], ["ord"])
        return top_k_with_total(found, k, [F.col("file_path"), F.col("ord"), F.col("cpp_name")]).drop("ord")

    def implementations(self, name: str, k: int = 10) -> DataFrame:
        """function_name, file_path, line_number, signature, rank, total: of the operator's base (else the nearest name), then of its dispatch targets."""
        impls = self["native_implementations"]
        native = M.native_lookup(self._query(name), self["native_functions"]).select("lookup_name").join(self["native_functions"], "lookup_name").select("base_name", "dispatch")
        first = native.first()  # one row
        base = first.base_name if first else name
        names = impls.groupBy(F.col("function_name").alias("name")).agg(F.min(F.struct("file_path", "ord")).alias("ord"))
        own = M.fuzzy_find(self._query(base), names).select(F.col("name").alias("function_name"), F.lit(0).alias("part"))
        more = [(v, 1) for v in (first.dispatch or {}).values() if v] if first else []
        wanted = own.union(self.spark.createDataFrame(more, "function_name string, part int")).groupBy("function_name").agg(F.min("part").alias("part"))
        rows = impls.join(F.broadcast(wanted), "function_name")  # as many rows as an operator has dispatch targets
        rows = dedupe_first(rows, ["function_name", "file_path", "line_number"], ["part", "ord"])
        return top_k_with_total(rows, k, [F.col("part"), F.col("file_path"), F.col("ord"), F.col("function_name")]).drop("part", "ord")

    def suggestions(self, name: str, k: int = 5) -> DataFrame:
        return M.similar_names(self._query(name), self["native_functions"].select(F.col("lookup_name").alias("name"), "ord"), k)

    def trace(self, name: str, focus: str = "full") -> dict[str, DataFrame]:
        """focus full, yaml or dispatch: which of definition, registrations and implementations are told."""
        _one_of(focus, "full", "yaml", "dispatch")
        self.need("bindings")
        out = {}
        if focus in ("full", "yaml"):
            out["definition"] = self.definition(name)
        if focus in ("full", "dispatch"):
            out["registrations"] = self.registrations(name)
        if focus == "full":
            out["implementations"] = self.implementations(name)
        return out

    # ------------------------------------------------------------ search

    def search(self, query: str, mode: str = "bindings", backend: str = "", limit: int = 10) -> DataFrame:
        """bindings: names that hold query, on a backend that holds backend. kernels: names that hold query (15 of them)."""
        _one_of(mode, "bindings", "kernels")
        self.need("bindings")
        if mode == "kernels":
            rows = self["cuda_kernels"].where(holds(F.col("name"), query))
            rows = rows.select("name", "file_path", "line_number", F.slice("called_by", 1, 3).alias("callers"), "ord")
            return top_k_with_total(rows, 15, [F.col("file_path"), F.col("ord")]).drop("ord")
        rows = self["bindings"].where(holds(F.col("python_name"), query) | holds(F.col("cpp_name"), query))
        if backend:
            rows = rows.where(holds(F.col("dispatch_key"), backend))
        rows = dedupe_first(rows.select("python_name", "cpp_name", "dispatch_key", *ORDER, "line"), ["python_name", "cpp_name", "dispatch_key"], ORDER)
        return top_k_with_total(rows, limit, [F.col("file_path"), F.col("ord"), F.col("python_name")]).drop("ord")

    # ------------------------------------------------------------ graph

    def graph(self, name: str, mode: str = "callers", depth: int = 2, focus: str = "callers") -> DataFrame:
        """calls, callers: neighbours. impact: everything that calls it, 15 a depth; with focus full, the Python entry points instead."""
        _one_of(mode, "calls", "callers", "impact")
        _one_of(focus, "callers", "full")
        self.need("call_edges")
        edges, places = self["call_edges"], self["function_locations"]
        if mode != "impact":
            return G.listed(edges, places, name, mode == "calls")
        levels = G.impact(edges, name, depth)
        if focus == "full":
            return G.entry_points(levels, self["bindings"])
        rows = levels.join(places.select("name", "file", "line"), "name", "left")
        return top_k_with_total(rows, 15, [F.col("name")], ["depth"])

    # ------------------------------------------------------------ modules

    def modules(self, name: str, mode: str = "trace", focus: str = "methods") -> DataFrame:
        """trace: the class of that name (else the first that holds it) with its methods. list: nn, optim, all, or classes that hold name."""
        _one_of(mode, "trace", "list")
        self.need("py_classes")
        rows = self["py_classes"]
        if mode == "trace":
            _one_of(focus, "methods", "full")
            last = name.rpartition(".")[2]
            tier = F.when(F.lower("name") == last.lower(), 0).when(holds(F.col("name"), last), 1)
            found = best_tier(rows.withColumn("tier", tier).where("tier is not null").withColumn("q", F.lit(name)), ["q"], "tier")
            cols = ["name", "qualified_name", "file_path", "line_number"] + (["bases", "is_module", excerpt(F.col("docstring")).alias("docstring")] if focus == "full" else [])
            shown = F.transform(F.slice("methods", 1, 10), lambda m: F.concat(m["name"], F.coalesce(m["signature"], F.lit("()"))))
            found = found.select(*cols, shown.alias("methods"), F.size("methods").alias("n_methods"), "ord")
            return top_k_with_total(found, 1, [F.col("file_path"), F.col("ord")]).drop("ord")
        if name == "nn":
            found = rows.where("is_module").select(F.explode(module_groups(F.col("name"))).alias("group"), "name", "qualified_name")
            top = top_k_with_total(found, 1 << 30, [F.col("name"), F.col("qualified_name")], ["group"])
            return top.where("group <> 'layers' or rank <= 20")
        if name == "optim":
            found = rows.where(is_optimizer(F.col("qualified_name"), F.col("name"))).select("name", "qualified_name")
            return top_k_with_total(found, 20, [F.col("name"), F.col("qualified_name")])
        if name == "all":
            return top_k_with_total(rows.select("name").distinct(), 50, [F.col("name")])
        found = rows.where(holds(F.col("name"), name)).select("name", "file_path", "line_number", "ord")
        return top_k_with_total(found, 20, [F.col("file_path"), F.col("ord")]).drop("ord")

    def similar_classes(self, name: str, k: int = 5) -> DataFrame:
        return M.fuzzy_match(self._query(name.rpartition(".")[2]), self["py_classes"].select("name"), k)

    # ------------------------------------------------------------ tests

    def tests(self, query: str = "", mode: str = "find", limit: int = 10, focus: str = "all") -> DataFrame:
        """find: tests, classes, files and operator infos by section. utils: the utility files. file_info: three files with their tests."""
        _one_of(mode, "find", "utils", "file_info")
        if mode == "utils":
            return self["test_utilities"]
        self.need("test_files")
        if mode == "file_info":
            found = top_k_with_total(self["test_files"].where(holds(F.col("path"), query)), 3, [F.col("path")])
            name = F.concat(F.coalesce(F.concat("class", F.lit(".")), F.lit("")), F.col("name"))
            parts = self["test_classes"].select(F.col("file").alias("path"), F.lit("class").alias("section"), "name", "line", F.slice("bases", 1, 2).alias("bases"))
            parts = parts.unionByName(self["test_functions"].select(F.col("file").alias("path"), F.lit("function").alias("section"), name.alias("name"), "line", F.lit(None).cast("array<string>").alias("bases")))
            rows = parts.join(F.broadcast(found.select("path", F.col("rank").alias("file_rank"), F.col("total").alias("n_files"))), "path")  # three rows
            top = top_k_with_total(rows, 20, [F.col("line"), F.col("name")], ["path", "section"])
            return top.where("section = 'function' or rank <= 10")
        _one_of(focus, "all", "functions", "classes", "files")
        q = F.lit(query)
        shape = lambda df, section, name, file, line, extra: df.select(F.lit(section).alias("section"), name.alias("name"), file.alias("file"), line.alias("line"), extra.cast("string").alias("extra"))
        c, parts = F.col, []
        if focus in ("all", "functions"):
            parts.append(shape(self["opinfo_registry"].where(word_match(q, c("name"))), "opinfo", c("name"), c("file"), c("line"), F.lit(None)))
            parts.append(shape(self["test_functions"].where(word_match(q, c("name"))), "functions", c("name"), c("file"), c("line"), c("class")))
        if focus in ("all", "classes"):
            parts.append(shape(self["test_classes"].where(word_match(q, c("name"))), "classes", c("name"), c("file"), c("line"), F.array_join(F.slice("bases", 1, 2), ", ")))
        if focus in ("all", "files"):
            parts.append(shape(self["test_files"].where(holds(c("path"), query)), "files", c("path"), c("path"), F.lit(None).cast("int"), F.format_string("%d classes, %d tests", "n_classes", "n_functions")))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        top = top_k_with_total(rows, max(5, limit), [c("name"), c("file"), c("line")], ["section"])
        return top.where(F.when(c("section") == "functions", c("rank") <= limit).otherwise(c("rank") <= 5))

    # ------------------------------------------------------------ text

    def render(self, title: str, rows: DataFrame, most: int = 200) -> str:
        """Heading and one line for each of the first rows (tools give few)."""
        out = formatter().h2(title)
        for path in ("file_path", "file"):
            line = next((c for c in ("line", "line_number") if c in rows.columns), None)
            if path in rows.columns:
                place = relative_path(F.col(path), self.source)
                rows = rows.withColumn(path, location(place, F.col(line)) if line else place).drop(*([line] if line else []))
        found = rows.limit(most).collect()
        if not found:
            return out.text("Nothing found.").build()
        shown = [c for c in rows.columns if c not in ("rank", "total")]
        order = sorted(found, key=lambda r: (str(r["depth"]) if "depth" in rows.columns else "", r["rank"] if "rank" in rows.columns else 0))
        out.table(shown, [["" if r[c] is None else str(r[c]) for c in shown] for r in order])
        if "total" in rows.columns and len(found) < found[0]["total"] and "depth" not in rows.columns:
            out.blank().text(f"Showing {len(found)} of {found[0]['total']}")
        return out.build()


def _one_of(value: str, *options: str) -> None:
    if value not in options:
        raise ValueError(f"{value!r}: choose from {', '.join(options)}")
