"""A small source tree of our own text: what the scans and extractors are run on by the registered queries and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession

LONG_FORMULA = "a formula that is rather longer than sixty characters, so it is cut in the trace"
#: This file has line ends of another system.
WITH_CRLF = "aten/src/ATen/native/reg.cpp"

FILES = {
    "version.txt": "1.0\n",
    "torch/version.py": "v = 1\n",
    "aten/src/ATen/native/native_functions.yaml": """
- func: plus(Tensor self) -> Tensor
  variants: function, method
  dispatch:
    CPU, CUDA: plus_kernel
    MPS: plus_mps
  tags: pointwise
- func: minus.Tensor(Tensor self) -> Tensor
  structured: True
  tags: [core, pointwise]
- func: minus.Scalar(Tensor self) -> Tensor
  structured_delegate: minus.out
- func: times.out(Tensor self) -> Tensor
- func: times(Tensor self) -> Tensor
- nofunc: here
- func: "***bad"
- just text
""",
    "tools/autograd/derivatives.yaml": """
- name: plus(Tensor self) -> Tensor
  self: grad
  other: "@@"
  output_differentiability: [True]
  dispatch: x
  count: 3
- name: minus.Tensor(Tensor self)
  self: first
- name: minus.Tensor(Tensor self)
  self: last
- self: nameless
""",
    "aten/src/ATen/native/Plus.cpp": """#include <x>
Tensor plus(const Tensor& self) {
  if (self.ok()) {
    AT_DISPATCH_ALL_TYPES(self.type(), "plus_inner", [&] { helper(self); });
  }
  return plus_kernel(self);
}
static inline void plus_kernel(
    Tensor self) {
  helper(self);
}
Tensor& at::native::minus(Tensor self) {
  return other::helper(self);
}
void unrelated(int a) { }
  Tensor plus(int indented) { }
namespace other {
void helper(Tensor t) { plus_kernel(t); unknown(t); }
}
""",
    "aten/src/ATen/native/reg.cpp": """// é non-ASCII: ü
TORCH_LIBRARY(mine, m) {
  m.def("plus(Tensor a) -> Tensor");
  m.def(TORCH_SELECTIVE_SCHEMA("mine::minus(Tensor a) -> Tensor"));
  m.impl("plus", plus_impl);
  const char* s = "{";
}
}
TORCH_LIBRARY_FRAGMENT(frag, m) { m.def("solo(int a) -> int", &solo); }
TORCH_LIBRARY_IMPL(_, CUDA, m)
{
  m.impl("plus", TORCH_FN(plus_cuda));
}
PYBIND11_MODULE(_ext, m) {
  m.def("run", &do_run);
  m.def("lambda", [](int a) { return a; });
  py::class_<Engine, std::shared_ptr<Engine>>(m, "PlainEngine");
  py::class_<Engine>(m, "Engine")
      .def("start", &Engine::start)
      .def_static("make", &Engine::make)
      .def_readwrite("speed", &Engine::speed);
}
void outside(py::module& parent) {
  py::class_<Other, Base>(parent, "Other").def("go", [](Other& o) {}); x(); y.def("late", 1);
}
""",
    "aten/src/ATen/cuda/k.cu": """template <typename T>
__global__ void fill_kernel(T* out, int n) { }
__global__ void add_kernel(float* a,
                           float* b) { }
__global__ __launch_bounds__(256) void missed(int a) { }
void launch_a(int n) {
  if (n) {
    fill_kernel<<<1, 2>>>(n);
    fill_kernel <<<1, 2>>>(n);
  }
}
void launch_b(int n) const {
  fill_kernel<<<1, 2>>>(n); my_add_kernel<<<1, 1>>>(n);
}
""",
    "aten/src/ATen/test/skip.cpp": 'TORCH_LIBRARY(skipped, m) { m.def("no()"); }\n',
    "torch/nn/linear.py": '''"""Doc."""
import os, torch as t
from .module import Module
from x import (a, b as c)
__all__ = ["Linear", "Lazy"]
__all__ = ("tuple",)
try:
    import fast
    def guarded(): pass
except ImportError:
    pass

@final
class Linear(Module):
    """A layer."""
    def __init__(self, n: int, *args, bias=True, **kw) -> None:
        def inner(): pass
    @property
    def shape(self): return torch._C._shape(self)
    async def wait(self): pass
    class Nested: pass

class Indirect(Linear): pass
class Stack(nn.Module, Generic[T]): pass
class MSELoss(torch.nn.Module): pass
class Sequential(Module): pass
async def later(x: "Tensor" = 1): pass
def outer():
    class Local: pass
    return _C.call(torch.ops.aten.add)
''',
    "torch/nn/__init__.py": "from .linear import *\n__all__ = ['Linear']\n",
    "torch/nn/broken.py": "def (:\n",
    "torch/nn/test_skip.py": "class No: pass\n",
    "torch/nn/tests/no.py": "class No2: pass\n",
    "torch/optim/sgd.py": "class SGD(Optimizer): pass\nclass _Base: pass\n",
    "test/test_plus.py": '''class TestPlus(TestCase):
    def test_plus(self): pass
    async def test_async(self): pass
    def helper(self): pass
class NotATest:
    def test_plus_too(self): pass
def test_top(): pass
if True:
    def test_indented(): pass
def outer():
    class Inner(MyTestBase):
        def test_in(self): pass
''',
    "torch/testing/plain.py": "def test_quiet(): pass\n",
    "torch/testing/_internal/common_utils.py": "import pytest\ndef test_common(): pass\n",
    "torch/testing/_internal/opinfo/core.py": "ops = [OpInfo('plus'), UnaryUfuncInfo('nope'),\n  BinaryOpInfo(\n  \"minus\")]\n",
    "torch/testing/_internal/opinfo/definitions/more.py": "x = OpInfo('plus', 1)\n",
    "torch/testing/_internal/opinfo/definitions/deep/no.py": "x = OpInfo('deep')\n",
}

FILES["tools/autograd/derivatives.yaml"] = FILES["tools/autograd/derivatives.yaml"].replace("@@", LONG_FORMULA)
#: A compile database for entries of another place, in a tree of its own.
DATABASE = """[
  {"file": "aten/src/ATen/native/Plus.cpp", "directory": "/src", "command": "cc -O2 -Iinc -I dir -DX=1 -std=c++17 -c x.cpp"},
  {"file": "/src/c10/b.cpp", "directory": "/src", "arguments": ["cc", "-Wall", "-DY"]},
  {"file": "c10/test/no.cpp", "directory": "/src", "command": "cc"},
  {"file": "c10/no.cc", "directory": "/src", "command": "cc"},
  {"file": "/elsewhere/no.cpp", "directory": "/src", "command": "cc"}
]
"""


def contents() -> dict[str, bytes]:
    return {name: (text.replace("\n", "\r\n") if name == WITH_CRLF else text).encode() for name, text in FILES.items()}


def write(spark: SparkSession, root: str) -> None:
    """The tree below root, and the database below root/db, through whatever file system root names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, data in {**contents(), "db/build/compile_commands.json": DATABASE.encode()}.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(data))
        out.close()
