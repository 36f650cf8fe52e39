"""Decoding class files: a class's name and the classes it depends on, by the class file format of the JVM specification.

In full mode every class, descriptor and method type of the constant pool counts, and what only attributes name: generic signatures and
annotations.  An attribute counts only in classes of the version that brought it, or later ones.  In API mode only what the class shows: super class, interfaces, signatures, and the descriptors, signatures and exceptions of public or
protected members; nothing if the class or a class around it isn't public or protected.  Annotations and permitted subclasses are never API.
"""

from __future__ import annotations

import struct

_PUBLIC, _STATIC, _PROTECTED = 0x1, 0x8, 0x4
#: Bytes of a constant after its tag, by tag: fixed values of the class file format.
_CONSTANT_SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}

#: The class version (major, minor) since which an attribute means something: fixed values of the class file format, for the attributes read here.
_ATTRIBUTE_SINCE = {
    "Code": (45, 3), "Exceptions": (45, 3), "InnerClasses": (45, 3),
    "Signature": (49, 0), "RuntimeVisibleAnnotations": (49, 0), "RuntimeInvisibleAnnotations": (49, 0),
    "RuntimeVisibleParameterAnnotations": (49, 0), "RuntimeInvisibleParameterAnnotations": (49, 0), "AnnotationDefault": (49, 0),
    "RuntimeVisibleTypeAnnotations": (52, 0), "RuntimeInvisibleTypeAnnotations": (52, 0),
    "ModuleMainClass": (53, 0),
    "Record": (60, 0),
}


def modified_utf8(raw: bytes) -> str:
    """Text of the JVM's own UTF-8: zero in two bytes, supplementary characters as surrogate pairs."""
    return raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def descriptor_names(text: str) -> set[str]:
    """The internal class names of a descriptor."""
    return {part.partition(";")[0] for part in _after_type_letters(text)}


def _after_type_letters(text: str) -> list[str]:
    out, i = [], 0
    while i < len(text):
        if text[i] == "L":
            end = text.index(";", i)
            out.append(text[i + 1 : end])
            i = end
        i += 1
    return out


def signature_names(text: str) -> set[str]:
    """The internal class names of a generic signature, without type variables and without the simple names of nested classes of generic ones."""
    out: set[str] = set()
    i = 0

    def until(stops: str) -> str:
        nonlocal i
        start = i
        while text[i] not in stops:
            i += 1
        return text[start:i]

    def type_() -> None:
        nonlocal i
        kind = text[i]
        i += 1
        if kind == "L":
            out.add(until("<;."))
            while text[i] != ";":
                mark = text[i]
                i += 1
                if mark == "<":
                    while text[i] != ">":
                        if text[i] in "*+-":
                            i += 1
                        else:
                            type_()
                    i += 1
                else:
                    until("<;.")
            i += 1
        elif kind == "T":
            until(";")
            i += 1
        elif kind == "[":
            type_()

    if text.startswith("<"):
        i = 1
        while text[i] != ">":
            until(":")
            while text[i] == ":":
                i += 1
                if text[i] not in ":>" and text[i] in "LT[":
                    type_()
        i += 1
    while i < len(text):
        if text[i] in "()^":
            i += 1
        else:
            type_()
    return out


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> int:
        (value,) = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return value

    def u1(self) -> int:
        return self.take(">B")

    def u2(self) -> int:
        return self.take(">H")

    def u4(self) -> int:
        return self.take(">I")

    def raw(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]


class ClassFile:
    """One class file, decoded: ``name`` (internal, None if the bytes are no class file) and ``deps`` (internal names, without the class itself)."""

    def __init__(self, data: bytes, api_only: bool = False):
        self.name: str | None = None
        self.deps: set[str] = set()
        self.api_only, self.visible = api_only, True
        if data[:4] != b"\xca\xfe\xba\xbe":
            return
        r = self.r = _Reader(data)
        r.at = 4
        minor, major = r.u2(), r.u2()
        self.version = (major, minor)
        self.constants = self._pool()
        access = r.u2()
        self.name = self._class(r.u2())
        above = r.u2()
        shown = [self._class(c) for c in (above, *(r.u2() for _ in range(r.u2()))) if c]
        for name in shown:
            self._add_class(name)
        for _ in range(2):
            for _ in range(r.u2()):
                flags, _, kind = r.u2(), r.u2(), r.u2()
                member = self._is_api(flags)
                if member or not api_only:
                    self.deps |= descriptor_names(self._text(kind))
                self._attributes(member)
        self._attributes(True)
        if not api_only:
            self._constants()
        elif not self.visible or not self._is_api(access):
            self.deps = set()
        self.deps.discard(self.name)

    @staticmethod
    def _is_api(flags: int) -> bool:
        return bool(flags & (_PUBLIC | _PROTECTED))

    def _pool(self) -> list:
        r, out, n = self.r, [None], self.r.u2()
        while len(out) < n:
            tag = r.u1()
            if tag == 1:
                out.append((1, r.raw(r.u2())))
            elif tag in _CONSTANT_SIZES:
                out.append((tag, r.raw(_CONSTANT_SIZES[tag])))
                if tag in (5, 6):
                    out.append(None)
            else:
                raise ValueError(f"unknown constant tag {tag}")
        return out

    def _text(self, i: int) -> str:
        return modified_utf8(self.constants[i][1])

    def _class(self, i: int) -> str:
        return self._text(struct.unpack(">H", self.constants[i][1])[0])

    def _add_class(self, name: str) -> None:
        self.deps |= descriptor_names(name) if name.startswith("[") else {name}

    def _constants(self) -> None:
        for x in self.constants:
            if x and x[0] == 7:
                self._add_class(self._text(struct.unpack(">H", x[1])[0]))
            elif x and x[0] == 12:
                self.deps |= descriptor_names(self._text(struct.unpack(">HH", x[1])[1]))
            elif x and x[0] == 16:
                self.deps |= descriptor_names(self._text(struct.unpack(">H", x[1])[0]))

    def _attributes(self, shown: bool) -> None:
        r, full = self.r, not self.api_only
        for _ in range(r.u2()):
            name, size = self._text(r.u2()), r.u4()
            end = r.at + size
            if self.version < _ATTRIBUTE_SINCE.get(name, (0, 0)):
                name = ""
            if name == "Signature" and (shown or full):
                self.deps |= signature_names(self._text(r.u2()))
            elif name == "Exceptions" and (shown or full):
                for _ in range(r.u2()):
                    self._add_class(self._class(r.u2()))
            elif name == "InnerClasses":
                self._inner()
            elif name == "ModuleMainClass":
                self._add_class(self._class(r.u2()))
            elif name == "Record":
                for _ in range(r.u2()):
                    r.u2()
                    kind = self._text(r.u2())
                    self.deps |= descriptor_names(kind)
                    self._attributes(shown)
            elif name == "Code" and full:
                r.at += 4
                r.at += 4 + struct.unpack_from(">I", r.data, r.at)[0]
                r.at += 2 + 8 * struct.unpack_from(">H", r.data, r.at)[0]
                self._attributes(shown)
            elif full and name in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations"):
                self._annotations()
            elif full and name in ("RuntimeVisibleParameterAnnotations", "RuntimeInvisibleParameterAnnotations"):
                for _ in range(r.u1()):
                    self._annotations()
            elif full and name in ("RuntimeVisibleTypeAnnotations", "RuntimeInvisibleTypeAnnotations"):
                for _ in range(r.u2()):
                    self._target()
                    self._annotation()
            elif full and name == "AnnotationDefault":
                self._value()
            r.at = end

    def _inner(self) -> None:
        """A class is API only if it and the classes around it are; top level classes are taken for public."""
        r = self.r
        for _ in range(r.u2()):
            inner, _, _, flags = r.u2(), r.u2(), r.u2(), r.u2()
            name = self._class(inner)
            if (self.name == name or self.name.startswith(f"{name}$")) and not self._is_api(flags):
                self.visible = False

    def _annotations(self) -> None:
        for _ in range(self.r.u2()):
            self._annotation()

    def _annotation(self) -> None:
        r = self.r
        self.deps |= descriptor_names(self._text(r.u2()))
        for _ in range(r.u2()):
            r.u2()
            self._value()

    def _value(self) -> None:
        r = self.r
        tag = chr(r.u1())
        if tag == "e":
            self.deps |= descriptor_names(self._text(r.u2()))
            r.u2()
        elif tag == "c":
            self.deps |= descriptor_names(self._text(r.u2()))
        elif tag == "@":
            self._annotation()
        elif tag == "[":
            for _ in range(r.u2()):
                self._value()
        else:
            r.u2()

    def _target(self) -> None:
        r = self.r
        target = r.u1()
        if target in (0x40, 0x41):
            r.at += 6 * r.u2()
        else:
            r.at += 1 if target in (0x00, 0x01, 0x16) else 0 if target in (0x13, 0x14, 0x15) else 3 if 0x47 <= target <= 0x4B else 2
        r.at += 2 * r.u1()


def decode(data: bytes, api_only: bool = False) -> tuple[str | None, list[str]]:
    """The dotted name of a class file and the sorted dotted names it depends on."""
    found = ClassFile(data, api_only)
    if found.name is None:
        return None, []
    return found.name.replace("/", "."), sorted(x.replace("/", ".") for x in found.deps)
