from codeloom.streaming import reindex


def test_files_are_followed(spark, tmp_path):
    src, out, checkpoint = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    (src / "test").mkdir(parents=True)
    (src / "a.cpp").write_text('TORCH_LIBRARY(one, m) { m.def("x()"); }\n')
    (src / "b.cu").write_text("__global__ void k(int n) { }\nvoid f() { k<<<1, 1>>>(2); }\n")
    (src / "test" / "no.cpp").write_text('TORCH_LIBRARY(no, m) { m.def("y()"); }\n')

    def names():
        reindex.watch(spark, str(src), out, checkpoint).awaitTermination(120)
        return sorted(r.python_name for r in reindex.current(spark, out).collect())

    assert names() == ["k", "one.x"]
    assert [r.called_by for r in reindex.current(spark, out, "cuda_kernels").collect()] == [["f"]]
    (src / "c.cc").write_text('TORCH_LIBRARY(two, m) { m.def("z()"); }\n')
    assert names() == ["k", "one.x", "two.z"]
    assert names() == ["k", "one.x", "two.z"]  # nothing new
