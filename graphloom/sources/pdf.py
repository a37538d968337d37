"""The text of a PDF file's pages: objects, page tree, content streams and the fonts' character maps."""

from __future__ import annotations

import re
import zlib

_SPACE, _DELIMITERS = b" \t\r\n\f\0", b" \t\r\n\f\0()<>[]{}/%"
_OBJECT = re.compile(rb"(?<!\d)(\d+)[ \t\r\n]+(\d+)[ \t\r\n]+obj\b")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Ref(int):
    """The number of another object."""


class Name(str):
    """A name, or an operator."""


class _Reader:
    """Values of PDF syntax from a place in bytes on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _skip(self) -> None:
        d, n = self.data, len(self.data)
        while self.at < n:
            if d[self.at] in _SPACE:
                self.at += 1
            elif d[self.at] == 37:  # a comment goes to the line's end
                while self.at < n and d[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def _word(self) -> bytes:
        start = self.at
        while self.at < len(self.data) and self.data[self.at] not in _DELIMITERS:
            self.at += 1
        return self.data[start : self.at]

    def value(self):
        """The next value; None at the end, and where a bracket closes."""
        self._skip()
        d = self.data
        if self.at >= len(d) or d[self.at] in b"]})" or d[self.at : self.at + 2] == b">>":
            return None
        if d[self.at : self.at + 2] == b"<<":
            self.at += 2
            items = self._until(b">>")
            return {str(k): v for k, v in zip(items[::2], items[1::2])}
        c = d[self.at : self.at + 1]
        if c in b"[{":
            self.at += 1
            return self._until(b"]" if c == b"[" else b"}")
        if c == b"<":
            end = d.find(b">", self.at)
            end = len(d) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"(":
            return self._string()
        if c == b"/":
            self.at += 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), self._word()).decode("latin-1"))
        word = self._word()
        if not word:  # a stray mark
            self.at += 1
            return Name("")
        if re.fullmatch(rb"\d+", word) and (m := re.compile(rb"[ \t\r\n]+\d+[ \t\r\n]+R(?![A-Za-z0-9])").match(d, self.at)):
            self.at = m.end()
            return Ref(word)
        try:
            return float(word) if b"." in word else int(word)
        except ValueError:
            return {b"true": True, b"false": False, b"null": Name("null")}.get(word, Name(word.decode("latin-1")))

    def _until(self, end: bytes) -> list:
        out = []
        while self.at < len(self.data):
            v = self.value()
            if v is None:
                self._skip()
                if self.data[self.at : self.at + len(end)] == end or self.at >= len(self.data):
                    self.at += len(end)
                    break
                self.at += 1  # another bracket that closes nothing
                continue
            out.append(v)
        return out

    def _string(self) -> bytes:
        out, depth, d = bytearray(), 0, self.data
        while self.at < len(d):
            c = d[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                e = d[self.at : self.at + 1]
                self.at += 1
                if m := re.compile(rb"[0-7]{1,3}").match(d, self.at - 1):
                    out.append(int(m[0], 8) & 255)
                    self.at = m.end()
                elif e == b"\r":
                    self.at += d[self.at : self.at + 1] == b"\n"
                elif e != b"\n":
                    out += _ESCAPES.get(e, e)
                continue
            if c == b"(":
                depth += 1
                if depth == 1:
                    continue
            elif c == b")":
                depth -= 1
                if not depth:
                    break
            out += c
        return bytes(out)


class Pdf:
    """The objects of a file, found by their heads, so that a broken cross-reference table does no harm; of several with one
    number the last counts. Objects inside object streams count too. Encrypted files are refused."""

    def __init__(self, data: bytes):
        if not data.lstrip(b"\xef\xbb\xbf" + _SPACE).startswith(b"%PDF") or re.search(rb"/Encrypt[ \t\r\n]+\d+[ \t\r\n]+\d+[ \t\r\n]+R", data):
            raise ValueError("not a PDF file, or one that is encrypted")
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        at = 0
        while m := _OBJECT.search(data, at):
            reader = _Reader(data, m.end())
            value, number = reader.value(), int(m[1])
            self.objects[number], at = value, max(reader.at, m.end())
            if isinstance(value, dict) and (s := re.compile(rb"[ \t\r\n]*stream(\r\n|\n|\r)").match(data, at)):
                length = value.get("Length")
                end = s.end() + length if type(length) is int and data[s.end() + length :].lstrip(_SPACE)[:9] == b"endstream" else data.find(b"endstream", s.end())
                end = len(data) if end < 0 else end
                self.streams[number], at = data[s.end() : end], end
        for number in [n for n, v in self.objects.items() if isinstance(v, dict) and v.get("Type") == "ObjStm"]:
            held, body = self.objects[number], self.stream(number)
            reader = _Reader(body)
            heads = [reader.value() for _ in range(2 * self.get(held["N"]))]
            for inner, offset in zip(heads[::2], heads[1::2]):
                self.objects.setdefault(inner, _Reader(body, self.get(held["First"]) + offset).value())

    def get(self, value):
        """The value itself, or what it refers to."""
        for _ in range(20):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(int(value))
        return None

    def stream(self, number: int) -> bytes:
        filters = self.get(self.objects[number].get("Filter")) or []
        data = self.streams.get(number, b"")
        for f in filters if isinstance(filters, list) else [filters]:
            if self.get(f) not in ("FlateDecode", "Fl"):
                raise ValueError(f"streams of kind {f} are not read")
            data = zlib.decompressobj().decompress(data)
        return data

    def pages(self) -> list[tuple[dict, dict]]:
        """Each page and its resources, in order."""
        root = next((v for v in reversed(self.objects.values()) if isinstance(v, dict) and v.get("Type") == "Catalog"), {})
        out, seen = [], set()

        def walk(node, resources) -> None:
            key, node = node, self.get(node)
            if not isinstance(node, dict) or (isinstance(key, Ref) and int(key) in seen):
                return
            seen.add(int(key) if isinstance(key, Ref) else id(node))
            resources = self.get(node.get("Resources")) or resources
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, resources)
            else:
                out.append((node, resources))

        walk(root.get("Pages"), {})
        return out

    def _characters(self, font: dict) -> tuple[int, dict[int, str]] | None:
        """Bytes of a code and the map of codes to text of a font that has one."""
        ref = font.get("ToUnicode")
        if not isinstance(ref, Ref) or int(ref) not in self.streams:
            return None
        reader, stack, chars, width = _Reader(self.stream(int(ref))), [], {}, 1
        number = lambda b: int.from_bytes(b, "big")
        text = lambda b: b.decode("utf-16-be", "replace")
        while (v := reader.value()) is not None:
            if not isinstance(v, Name) or not str(v).startswith("end"):
                stack = [] if isinstance(v, Name) and str(v).startswith("begin") else [*stack, v]
                continue
            if v == "endcodespacerange" and stack:
                width = len(stack[0])
            elif v == "endbfchar":
                chars.update((number(a), text(b)) for a, b in zip(stack[::2], stack[1::2]))
            elif v == "endbfrange":
                for lo, hi, to in zip(stack[::3], stack[1::3], stack[2::3]):
                    for i, code in enumerate(range(number(lo), min(number(hi), number(lo) + 65_535) + 1)):
                        chars[code] = text(to[i]) if isinstance(to, list) else text(to[:-2] + ((number(to[-2:]) + i) & 0xFFFF).to_bytes(2, "big"))
        return width, chars

    def page_text(self, page: dict, resources: dict) -> str:
        contents = page.get("Contents")
        listed = self.get(contents)
        parts = listed if isinstance(listed, list) else [contents]
        body = b"\n".join(self.stream(int(p)) for p in parts if isinstance(p, Ref) and int(p) in self.streams)
        fonts = {k: self._characters(self.get(v) or {}) for k, v in (self.get(resources.get("Font")) or {}).items()}
        out, stack, font, named, reader = [], [], None, "", _Reader(body)

        def show(raw: bytes) -> None:
            if font:
                width, chars = font
                out.append("".join(chars.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width)))
            else:
                out.append(raw.decode("cp1252", "replace"))

        def line() -> None:
            if out and not out[-1].endswith("\n"):
                out.append("\n")

        while reader.at < len(body):
            v = reader.value()
            if v is None:
                reader.at += 1
                continue
            if not isinstance(v, Name):
                stack.append(v)
                continue
            if v == "Tf":
                font = fonts.get(named)
            elif v in ("'", '"', "T*", "TD", "ET") or v == "Td" and stack[-1:] not in ([0], [0.0]):
                line()
            elif v == "Tm" and len(stack) >= 6 and out and out[-1].strip():
                line()
            if v in ("Tj", "'", '"') and stack and isinstance(stack[-1], bytes):
                show(stack[-1])
            elif v == "TJ" and stack and isinstance(stack[-1], list):
                for x in stack[-1]:
                    if isinstance(x, bytes):
                        show(x)
                    elif isinstance(x, (int, float)) and x < -200:  # a gap as wide as a space
                        out.append(" ")
            elif v == "BI":  # an image among the text
                end = body.find(b"EI", reader.at)
                reader.at = len(body) if end < 0 else end + 2
            named, stack = str(v), []
        return "".join(out).strip("\n")


def pdf_text(content: bytes) -> str:
    """The text of a PDF file, a form feed between pages. Pages without text are empty; a file that cannot be read is an error."""
    pdf = Pdf(content)
    return "\f".join(pdf.page_text(*page) for page in pdf.pages())
