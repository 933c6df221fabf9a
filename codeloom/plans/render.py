"""Text of results: compact or Markdown."""

from __future__ import annotations


class Compact:
    """Plain text in few words: no table headers, no two blank lines in a row."""

    def __init__(self) -> None:
        self.lines: list[str] = []

    def _add(self, line: str):
        self.lines.append(line)
        return self

    def h2(self, text: str):
        return self._add(f"[{text}]")

    def h3(self, text: str):
        return self._add(text)

    def bold(self, label: str, value: str):
        return self._add(f"{label}: {value}")

    def code(self, label: str, value: str):
        return self.bold(label, value)

    def item(self, text: str, indent: int = 0):
        return self._add("  " * indent + f"- {text}")

    def text(self, text: str):
        return self._add(text)

    def blank(self):
        return self if not self.lines or self.lines[-1] == "" else self._add("")

    def table(self, headers: list[str], rows: list[list[str]]):
        for row in rows:
            self._add("  ".join(map(str, row)))
        return self

    def codeblock(self, code: str, lang: str = ""):
        return self._add(code)

    def build(self) -> str:
        return "\n".join(self.lines)


class Markdown(Compact):
    def h2(self, text: str):
        return self._add(f"## {text}\n")

    def h3(self, text: str):
        return self._add(f"### {text}\n")

    def bold(self, label: str, value: str):
        return self._add(f"**{label}:** {value}")

    def code(self, label: str, value: str):
        return self.bold(label, f"`{value}`")

    def blank(self):
        return self._add("")

    def table(self, headers: list[str], rows: list[list[str]]):
        for row in (headers, ["-" * max(3, len(h)) for h in headers], *rows):
            self._add("| " + " | ".join(map(str, row)) + " |")
        return self

    def codeblock(self, code: str, lang: str = ""):
        return self._add(f"```{lang}\n{code}\n```")


MODES = {"compact": Compact, "markdown": Markdown}
_mode = "compact"


def set_mode(mode: str) -> None:
    global _mode
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; choose from {', '.join(MODES)}")
    _mode = mode


def formatter() -> Compact:
    return MODES[_mode]()
