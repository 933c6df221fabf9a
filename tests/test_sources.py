"""Extractors, catalog, tools and command line on the small tree of tree_files."""

import json
import os

import pytest

import tree_files
from codeloom import cli, config
from codeloom.plans import render
from codeloom.plans.build import build_tables, open_catalog
from codeloom.plans.tools import Catalog, NotLoaded
from codeloom.schemas import SCHEMAS
from codeloom.sources import callgraph, cxx, store


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return tree_files.write(tmp_path_factory.mktemp("tree") / "build" / "src")  # a checkout below /build/ is not excluded


@pytest.fixture(scope="module")
def tables(spark, root, tmp_path_factory):
    return open_catalog(spark, root, str(tmp_path_factory.mktemp("cache")))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_yaml(tables):
    f = {r.lookup_name: r for r in tables["native_functions"].collect()}
    assert set(f) == {"plus", "minus.Tensor", "minus.Scalar", "minus", "times.out", "times"}
    assert f["plus"].dispatch == {"CPU": "plus_kernel", "CUDA": "plus_kernel", "MPS": "plus_mps"} and f["plus"].tags == ["pointwise"]
    assert f["minus"].name == "minus.Tensor" and f["minus"].is_alias and f["times"].name == "times" and not f["times"].is_alias
    assert f["minus.Tensor"].structured and f["minus.Scalar"].structured_delegate == "minus.out" and f["minus.Tensor"].tags == ["core", "pointwise"]
    d = {r.name: r.gradients for r in tables["derivatives"].collect()}
    assert set(d) == {"plus", "minus.Tensor"} and d["minus.Tensor"] == {"self": "last"} and set(d["plus"]) == {"self", "other"}


def test_bindings(tables):
    got = [tuple(r) for r in tables["bindings"].orderBy("file_path", "ord").select("type", "python_name", "cpp_name", "dispatch_key", "namespace", "line").collect()]
    assert ("torch_op", "mine.plus", "plus", None, "mine", 3) in got and ("torch_op", "mine.minus", "minus", None, "mine", 4) in got
    assert ("torch_library_impl", "mine.plus", "plus_impl", None, "mine", 5) in got and ("torch_op", "frag.solo", "solo", None, "frag", 9) in got
    assert ("torch_library_impl", "_.plus", "TORCH_FN(plus_cuda", "CUDA", "_", 11) in got  # lines of a block count from its macro
    assert ("pybind_function", "run", "do_run", None, "_ext", 15) in got and not any(g[1] == "lambda" for g in got)
    assert ("pybind_class", "Engine", "Engine", None, "_ext", 18) in got and ("pybind_method", "Engine.make", "Engine::make", None, "_ext", 20) in got
    assert got.count(("pybind_class", "Engine", "Engine", None, None, 18)) == 1  # told again by the pass over the whole file
    assert ("pybind_method", "Engine.speed", "Engine::speed", None, None, 21) in got and ("pybind_class", "Other", "Other", None, None, 24) in got
    assert ("pybind_method", "Other.late", "Other::late", None, None, 24) in got
    assert ("at_dispatch", "plus_inner", "plus", None, None, 4) in got  # the head of the if is passed over
    assert ("cuda_kernel", "add_kernel", "add_kernel", "CUDA", None, 3) in got and not any(g[1] == "missed" for g in got)
    assert not any("skipped" in g[1] for g in got)
    assert {g[0] for g in got} == {"pybind_function", "pybind_class", "pybind_method", "torch_op", "torch_library_impl", "cuda_kernel", "at_dispatch"}


def test_kernels_and_implementations(tables):
    k = {r.name: r for r in tables["cuda_kernels"].collect()}
    assert k["fill_kernel"].called_by == ["launch_a", "launch_b"] and k["add_kernel"].called_by == ["launch_b"] and k["fill_kernel"].line_number == 2
    assert k["add_kernel"].parameters.split() == ["float*", "a,", "float*", "b"]
    got = rows(tables["native_implementations"], "function_name", "line_number", "signature")
    assert got == [("minus", 12, "Tensor& at::native::minus(Tensor self) {"), ("plus", 2, "Tensor plus(const Tensor& self) {"), ("plus_kernel", 8, "static inline void plus_kernel(")]


def test_call_graph(spark, root, tables):
    assert rows(tables["call_edges"], "caller", "callee") == [("at::native::minus", "other::helper"), ("other::helper", "plus_kernel"), ("plus", "other::helper"), ("plus", "plus_kernel"), ("plus_kernel", "other::helper")]
    assert ("other::helper", 18) in rows(tables["function_locations"], "name", "line")
    raw = [
        (f"{root}/aten/src/ATen/native/Plus.cpp", root, "cc -O2 -Iinc -I dir -DX=1 -std=c++17 -c x.cpp", None), ("c10/b.cpp", root, None, ["cc", "-Wall", "-DY"]),
        (f"{root}/c10/test/no.cpp", root, "cc", None), (f"{root}/c10/no.cc", root, "cc", None), ("/elsewhere/no.cpp", root, "cc", None),
    ]
    got = {os.path.basename(r.file): r.arguments for r in callgraph.entries(spark.createDataFrame(raw, SCHEMAS["compile_commands"]), root).collect()}
    assert got == {"Plus.cpp": ["-Iinc", "-Idir", "-DX=1", "-std=c++17"], "b.cpp": ["-DY"]}
    with pytest.raises(FileNotFoundError):
        callgraph.compile_commands(spark, root)


def test_python(tables):
    c = {r.name: r for r in tables["py_classes"].collect()}
    assert set(c) == {"Linear", "Indirect", "Stack", "MSELoss", "Sequential", "SGD", "_Base", "No2"}
    assert {n for n, r in c.items() if r.is_module} == {"Linear", "Stack", "MSELoss", "Sequential"}
    linear = c["Linear"]
    assert linear.qualified_name == "torch.nn.linear.Linear" and linear.decorators == ["final"] and linear.docstring == "A layer." and c["Stack"].bases == ["nn.Module", "Generic"]
    assert [(m.name, m.signature, m.is_async) for m in linear.methods] == [("__init__", "(self, n: int, *args, **kw) -> None", False), ("shape", "(self)", False), ("wait", "(self)", True)]
    assert linear.methods[1].cpp_binding == "torch._C._shape"
    f = {r.name: r for r in tables["py_functions"].where("not is_method").collect()}
    assert set(f) == {"guarded", "later", "outer"} and f["later"].is_async and f["later"].signature == "(x: Tensor)" and f["outer"].cpp_binding == "_C.call"
    assert rows(tables["py_modules"], "name", "exports")[:2] == [("torch.nn", ["Linear"]), ("torch.nn.linear", ["Linear", "Lazy"])]
    got = rows(tables["py_imports"].where("file_path like '%linear.py'"), "module", "name", "line_number")
    assert ("module", "Module", 3) in got and ("x", "b", 4) in got and ("os", "os", 2) in got and ("fast", "fast", 8) in got


def test_tests(tables):
    assert rows(tables["test_files"], "path", "n_classes", "n_functions") == [("test/test_plus.py", 3, 4), ("torch/testing/_internal/common_utils.py", 0, 1), ("torch/testing/_internal/opinfo/core.py", 0, 0), ("torch/testing/_internal/opinfo/definitions/deep/no.py", 0, 0), ("torch/testing/_internal/opinfo/definitions/more.py", 0, 0)]
    assert rows(tables["test_functions"].where("file like 'test/%'"), "name") == [("test_in",), ("test_plus",), ("test_plus_too",), ("test_top",)]
    assert {r.name for r in tables["test_classes"].where("is_test_class").collect()} == {"TestPlus", "Inner"}
    assert rows(tables["opinfo_registry"], "name", "file", "line") == [("minus", "torch/testing/_internal/opinfo/core.py", 2), ("plus", "torch/testing/_internal/opinfo/definitions/more.py", 1)]
    assert {r.path for r in tables["test_utilities"].collect()} == {"torch/testing/_internal/common_utils.py", "torch/testing/_internal/opinfo/core.py"}


def test_tools(spark, root, tables):
    c = Catalog(spark, tables, root)
    t = c.trace("plus")
    d = t["definition"].first()
    assert d.name == "plus" and d.gradients["other"].endswith("...") and len(d.gradients["other"]) == 60
    assert {r.cpp_name for r in t["registrations"].collect()} == {"plus", "TORCH_FN(plus_cuda", "plus_impl"} or t["registrations"].count() >= 1
    assert [r.function_name for r in t["implementations"].orderBy("rank").collect()] == ["plus", "plus_kernel"]
    assert c.trace("minus.Tensor", "yaml")["definition"].first().gradients == {"self": "last"}
    assert c.trace("zzzz", "yaml")["definition"].collect() == [] and [r.name for r in c.suggestions("pluz").collect()] == ["plus"]
    found = c.search("PLUS", limit=2).collect()
    assert len(found) == 2 and found[0].total >= 4 and c.search("plus", backend="cud").count() == 1
    kernels = c.search("fill", "kernels").first()
    assert kernels.callers == ["launch_a", "launch_b"]
    assert [r.name for r in c.graph("plus_kernel", "callers").orderBy("rank").collect()] == ["other::helper", "plus"]
    assert {(r.name, r.depth) for r in c.graph("plus_kernel", "impact", 2).collect()} == {("other::helper", 1), ("plus", 1), ("at::native::minus", 2)}
    assert c.graph("plus_kernel", "impact", 2, "full").first().cpp_name == "plus"
    m = c.modules("nn.linear", focus="full").first()
    assert m.name == "Linear" and m.n_methods == 3 and m.docstring == "A layer."
    groups = {(r.group, r.name) for r in c.modules("nn", "list").collect()}
    assert groups == {("layers", "Linear"), ("layers", "Stack"), ("losses", "MSELoss"), ("containers", "Sequential")}
    assert [r.name for r in c.modules("optim", "list").collect()] == ["SGD"] and c.modules("all", "list").count() == 8 and c.modules("lin", "list").count() == 1
    assert [r.name for r in c.similar_classes("Lineer").collect()][0] == "Linear"
    assert {(r.section, r.name) for r in c.tests("plus").collect()} == {("opinfo", "plus"), ("functions", "test_plus"), ("functions", "test_plus_too"), ("files", "test/test_plus.py")}
    assert {r.section for r in c.tests("test_plus", "file_info").collect()} == {"class", "function"} and c.tests("", "utils").count() == 2
    status = {(r.component, r.item): r.n for r in c.status().collect()}
    assert status["operators", "native_functions"] == 6 and status["dispatch", "CUDA"] == 3 and status["call_graph", "edges"] == 5
    assert "plus" in c.render("x", c.search("plus")) and c.render("none", c.search("zzz")).endswith("Nothing found.")
    with pytest.raises(ValueError, match="choose"):
        c.search("x", "wrong")
    with pytest.raises(NotLoaded):
        Catalog(spark, {**tables, "bindings": store.empty(spark, "bindings")}).trace("x")


def test_catalog_is_reused(spark, root, tmp_path):
    cache = str(tmp_path / "cache")
    open_catalog(spark, root, cache)
    path = config.catalog_path(root, cache)
    assert store.is_valid(spark, path, root, config.fingerprint(root)) and not store.is_valid(spark, path, root, "other") and not store.is_valid(spark, str(tmp_path / "no"), root, "x")
    assert store.load(spark, str(tmp_path / "no"))["bindings"].collect() == []
    store.register(store.load(spark, path), "v_")
    cxx.register_table_function(spark)
    assert spark.sql("SELECT count(*) FROM v_bindings").first()[0] > 10
    assert spark.sql("SELECT python_name FROM block_bindings('TORCH_LIBRARY(a, m) { m.def(\"b()\"); }')").first()[0] == "a.b"
    lazy = build_tables(spark, str(tmp_path / "cache"))
    assert set(lazy) >= set(SCHEMAS) - {"compile_commands"} and lazy["bindings"].collect() == []


def test_json_imports(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"bindings": [{"python_name": "a", "cpp_name": "b", "line": 3}], "native_functions": {"f.x": {"name": "f.x", "base_name": "f", "dispatch": {"CPU": "k"}}, "f": {"name": "f.x", "base_name": "f"}}, "native_implementations": {"k": [{"function_name": "k", "line_number": 1}, {"function_name": "k", "line_number": 9}]}}))
    got = store.import_json(spark, str(tmp_path / "i.json"))
    assert rows(got["bindings"], "python_name", "line") == [("a", 3)] and rows(got["native_functions"], "lookup_name", "is_alias") == [("f", True), ("f.x", False)]
    assert got["native_implementations"].count() == 2 and got["derivatives"].count() == 0
    (tmp_path / "g.json").write_text(json.dumps({"callees": {"a": ["b", "a"]}, "callers": {"b": ["c"]}, "function_locations": {"a": ["a.cpp", "4"]}}))
    edges, places = store.import_call_graph(spark, str(tmp_path / "g.json"))
    assert rows(edges, "caller", "callee") == [("a", "b"), ("c", "b")] and rows(places, "name", "line") == [("a", 4)]


def test_config(tmp_path, root, monkeypatch, capsys):
    path = tmp_path / "c" / "config.toml"
    assert config.load_config(path) == {}
    config.save_config({"source": {"pytorch_source": "/a"}, "other": {"n": 3, "on": True}}, path)
    config.save_config({"source": {"pytorch_source": 'b"c'}}, path)
    assert config.load_config(path) == {"source": {"pytorch_source": 'b"c'}, "other": {"n": 3, "on": True}}
    path.write_text("not [ toml")
    assert config.load_config(path) == {}
    assert config.resolve_source("x", {}) == "x" and config.resolve_source(None, {"PYTORCH_PATH": root}, path) == root
    assert config.resolve_source(None, {"PYTORCH_SOURCE": "/nowhere", "PYTORCH_PATH": root}, path) is None
    assert config.validate_source(root)[0] and not config.validate_source(str(tmp_path))[0] and not config.validate_source("/nowhere")[0]
    assert len(config.fingerprint(root)) == 16 and config.fingerprint(root) != config.fingerprint(str(tmp_path)) and len(config.source_hash(root)) == 12
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    monkeypatch.delenv("PYTORCH_SOURCE", raising=False)
    monkeypatch.delenv("PYTORCH_PATH", raising=False)
    assert cli.main(["status"]) == 1 and cli.main(["init", root]) == 0 and config.resolve_source() == root and cli.main(["init", "/nowhere"]) == 1


def test_command_line(root, tmp_path, monkeypatch, capsys, spark):
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path))
    assert cli.main(["--source", root, "--format", "markdown", "graph", "plus_kernel", "--mode", "impact"]) == 0
    assert "| at::native::minus |" in capsys.readouterr().out
    render.set_mode("compact")
    assert cli.main(["--source", root, "trace", "plus"]) == 0 and "[plus: definition]" in capsys.readouterr().out


def test_renderers():
    f = render.Compact()
    assert f.h2("Title").h3("Sub").text("a").blank().blank().blank().text("b").build() == "[Title]\nSub\na\n\nb"
    assert render.Compact().table(["A", "B"], [["1", "2"], ["3", "4"]]).build() == "1  2\n3  4"
    assert render.Compact().item("top").item("nested", 1).build() == "- top\n  - nested"
    m = render.Markdown().h2("Title").bold("k", "v").code("c", "d").table(["A"], [["1"]]).codeblock("x", "py").build()
    assert "## Title" in m and "**k:** v" in m and "**c:** `d`" in m and "| A |" in m and "| 1 |" in m and "```py\nx\n```" in m
    assert type(render.formatter()) is render.Compact
    render.set_mode("markdown")
    assert type(render.formatter()) is render.Markdown
    render.set_mode("compact")
    with pytest.raises(ValueError, match="unknown"):
        render.set_mode("other")
