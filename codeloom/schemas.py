"""Schemas of the fact tables. ``ord`` is the place of a row within its file; rows are ordered by (file_path, ord)."""

PY_FUNCTION = "name string, qualified_name string, file_path string, line_number int, is_method boolean, is_async boolean, decorators array<string>, docstring string, signature string, class_name string, cpp_binding string"

SCHEMAS = {
    "source_files": "path string, rel_path string, ext string, size long, mtime timestamp, content string",
    "bindings": "python_name string, cpp_name string, type string, file_path string, line int, dispatch_key string, namespace string, cuda_kernel string, signature string, ord long",
    "cuda_kernels": "name string, file_path string, line_number int, template_params string, parameters string, called_by array<string>, ord long",
    "native_functions": "lookup_name string, name string, base_name string, signature string, dispatch map<string,string>, variants string, structured boolean, structured_delegate string, tags array<string>, is_alias boolean, ord long",
    "derivatives": "name string, signature string, gradients map<string,string>",
    "native_implementations": "function_name string, file_path string, line_number int, signature string, ord long",
    "call_edges": "caller string, callee string",
    "function_locations": "name string, file string, line int",
    "py_modules": "name string, file_path string, exports array<string>",
    "py_functions": PY_FUNCTION + ", ord long",
    "py_imports": "module string, name string, alias string, file_path string, line_number int",
    "test_files": "path string, full_path string, n_classes long, n_functions long",
    "test_classes": "name string, file string, line int, bases array<string>, is_test_class boolean, ord long",
    "test_functions": "name string, class string, file string, line int, ord long",
    "opinfo_registry": "name string, file string, line int",
    "test_utilities": "path string, full_path string, exists boolean",
    "compile_commands": "file string, directory string, command string, arguments array<string>",
    "index_meta": "source_path string, source_fingerprint string",
}


def _struct(fields: str) -> str:
    return "struct<" + ",".join(":".join(f.strip().split(" ", 1)) for f in fields.split(", ")) + ">"


SCHEMAS["py_classes"] = f"module string, name string, qualified_name string, file_path string, line_number int, bases array<string>, decorators array<string>, docstring string, is_module boolean, methods array<{_struct(PY_FUNCTION)}>, ord long"
