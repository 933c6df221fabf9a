"""Fixed values that results depend on. Directory and file lists are defaults: every function that uses one takes it as a parameter."""

# Directories below the source root.
CPP_DIRS = ["aten/src/ATen/native", "torch/csrc", "c10", "aten/src/ATen/core", "aten/src/ATen/cuda"]
PYTHON_DIRS = [
    "torch/nn", "torch/optim", "torch/autograd", "torch/jit", "torch/cuda", "torch/backends", "torch/fx", "torch/_dynamo", "torch/_inductor",
    "torch/_decomp", "torch/ao", "torch/distributed", "torch/export", "torch/_refs", "torch/_prims", "torch/nested", "torch/mps",
]
TEST_DIRS = ["test", "torch/testing", "torch/testing/_internal"]
OPINFO_DIRS = ["torch/testing/_internal/opinfo", "torch/testing/_internal/opinfo/definitions"]
UTILITY_FILES = [
    "torch/testing/_internal/common_utils.py", "torch/testing/_internal/common_device_type.py", "torch/testing/_internal/common_dtype.py",
    "torch/testing/_internal/common_cuda.py", "torch/testing/_internal/opinfo/core.py", "torch/testing/_internal/opinfo/definitions.py",
    "torch/testing/_internal/hypothesis_utils.py", "torch/testing/_comparison.py",
]
OPERATORS_YAML = "aten/src/ATen/native/native_functions.yaml"
DERIVATIVES_YAML = "tools/autograd/derivatives.yaml"
FINGERPRINT_FILES = ["version.txt", "torch/version.py", ".git/HEAD"]
PACKAGE_ROOTS = ["torch", "torchvision", "torchaudio"]
PATH_PREFIXES = ["pytorch/"]

# Substrings.
EXCLUDED = ["/test/", "/tests/", "test_", "_test.", "/third_party/", "/generated/", "/build/", "__pycache__", "/benchmarks/", "/examples/"]
BINDING_MARKS = ["TORCH_LIBRARY", "PYBIND11_MODULE", "pybind11", "py::class_<", "m.def(", "__global__", "AT_DISPATCH", "c10::Dispatcher", "RegisterOperators"]
TEST_MARKS = ["TestCase", "pytest", "instantiate_device_type_tests", "OpInfo", "make_tensor", "assert_close", "dtype_test", "gradcheck"]
MODULE_BASES = ["Module", "nn.Module", "torch.nn.Module"]
NATIVE_CALL_MARKS = ["torch._C", "torch.ops.", "_C."]
KEYWORDS = ["if", "for", "while", "switch", "catch", "return", "sizeof", "decltype", "defined", "alignof", "static_assert", "constexpr", "else", "do", "new", "delete", "throw"]

# Patterns, in the dialect that Java and Python share.
RE_IMPLEMENTATION = r"^(?:static\s+)?(?:inline\s+)?(?:TORCH_API\s+)?(?:Tensor&?|void|bool|int64_t|double|std::tuple<[^>]+>|at::Tensor)\s+(\w+)\s*\([^;]*\)\s*(?:const\s*)?\{"
RE_QUALIFIED_IMPLEMENTATION = r"^(?:Tensor&?|void)\s+(?:\w+::)+(\w+)\s*\([^;]*\)\s*\{"
RE_KERNEL = r"__global__\s+void\s+(\w+)(?:<([^>]+)>)?\s*\(([^)]*)\)"
RE_LAUNCH = r"(\w+)\s*<<<"
RE_DISPATCH = r'(AT_DISPATCH_\w+)\s*\(\s*([^,]+)\s*,\s*"([^"]+)"'
RE_ENCLOSING = r"(?:static\s+)?(?:inline\s+)?(?:\w+::)*(\w+)\s*\([^)]*\)\s*(?:const\s*)?\{"
RE_OPINFO = r"""OpInfo\s*\(\s*['"]([^'"]+)['"]"""
RE_MODULE_BLOCK = r"PYBIND11_MODULE\s*\(\s*(\w+)\s*,\s*\w+\s*\)"
RE_FUNCTION_DEF = r'm\.def\s*\(\s*"([^"]+)"\s*,\s*&([^\s,)]+)'
RE_MODULE_CLASS = r'py::class_<([^>]+)>\s*\(\s*m\s*,\s*"([^"]+)"'
RE_ANY_CLASS = r'py::class_<([^>]+)>\s*\(\s*\w+\s*,\s*"([^"]+)"'
RE_METHOD_REF = r'\.def(?:_static|_readwrite|_readonly)?\s*\(\s*"([^"]+)"\s*,\s*&([^\s,)]+)'
RE_METHOD = r'\.def(?:_static|_readwrite|_readonly)?\s*\(\s*"([^"]+)"'
RE_LIBRARY = r"TORCH_LIBRARY(?:_FRAGMENT)?\s*\(\s*(\w+)\s*,\s*(\w+)\s*\)"
RE_LIBRARY_IMPL = r"TORCH_LIBRARY_IMPL\s*\(\s*([_\w]+)\s*,\s*(\w+)\s*,\s*(\w+)\s*\)"
RE_OP_DEFS = [r'm\.def\s*\(\s*"([^"]+)"', r'm\.def\s*\(\s*TORCH_SELECTIVE_SCHEMA\s*\(\s*"([^"]+)"']
RE_OP_NAME = r"(?:\w+::)?(\w+)"
RE_OP_IMPL = r'm\.impl\s*\(\s*"([^"]+)"\s*,\s*([^\s,)]+)'

# Widths and limits.
SIGNATURE_WIDTH, FORMULA_WIDTH, EXCERPT_WIDTH = 100, 60, 150
MAX_DEPTH = 5
