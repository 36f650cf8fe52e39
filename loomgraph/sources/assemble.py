"""Writing class files: the constant pool, members and attributes that dependencies are read from, for tests and for queries on tables as class files."""

from __future__ import annotations

import io
import struct
import zipfile

from pyspark.sql import SparkSession

PUBLIC, PRIVATE, PROTECTED = 0x1, 0x2, 0x4


class ClassWriter:
    """Collects a class; names are internal ones (a/b/C).  ``bytes`` gives the class file."""

    def __init__(self, name: str, above: str = "java/lang/Object", access: int = PUBLIC, version: tuple[int, int] = (52, 0)):
        self.constants: dict[tuple, int] = {}
        self.version = version
        self.head = struct.pack(">HHH", access, self.class_(name), self.class_(above))
        self.interfaces: list[int] = []
        self.fields: list[bytes] = []
        self.methods: list[bytes] = []
        self.attributes: list[bytes] = []

    def _constant(self, tag: int, content: bytes) -> int:
        return self.constants.setdefault((tag, content), len(self.constants) + 1)

    def text(self, value: str) -> int:
        """The index of a text."""
        raw = value.encode()
        return self._constant(1, struct.pack(">H", len(raw)) + raw)

    def class_(self, name: str) -> int:
        """The index of a class."""
        return self._constant(7, struct.pack(">H", self.text(name)))

    def name_and_type(self, name: str, descriptor: str) -> int:
        """The index of a name with a descriptor, as instructions refer to it."""
        return self._constant(12, struct.pack(">HH", self.text(name), self.text(descriptor)))

    def attribute(self, name: str, content: bytes) -> bytes:
        """An attribute's bytes."""
        return struct.pack(">HI", self.text(name), len(content)) + content

    def signature(self, value: str) -> bytes:
        """A generic signature."""
        return self.attribute("Signature", struct.pack(">H", self.text(value)))

    def exceptions(self, *names: str) -> bytes:
        """The exceptions of a method."""
        return self.attribute("Exceptions", struct.pack(">H", len(names)) + b"".join(struct.pack(">H", self.class_(x)) for x in names))

    def annotations(self, *descriptors: str) -> bytes:
        """Annotations without values."""
        return self.attribute("RuntimeVisibleAnnotations", struct.pack(">H", len(descriptors)) + b"".join(struct.pack(">HH", self.text(x), 0) for x in descriptors))

    def inner_classes(self, *found: tuple[str, int]) -> bytes:
        """Nested classes (name, access)."""
        return self.attribute("InnerClasses", struct.pack(">H", len(found)) + b"".join(struct.pack(">HHHH", self.class_(name), 0, 0, access) for name, access in found))

    def _member(self, access: int, name: str, descriptor: str, attributes: tuple[bytes, ...]) -> bytes:
        return struct.pack(">HHHH", access, self.text(name), self.text(descriptor), len(attributes)) + b"".join(attributes)

    def field(self, access: int, name: str, descriptor: str, *attributes: bytes) -> None:
        """Adds a field."""
        self.fields.append(self._member(access, name, descriptor, attributes))

    def method(self, access: int, name: str, descriptor: str, *attributes: bytes) -> None:
        """Adds a method."""
        self.methods.append(self._member(access, name, descriptor, attributes))

    def bytes(self) -> bytes:
        """The class file."""
        pool = b"".join(bytes([tag]) + content for tag, content in self.constants)
        parts = [struct.pack(">H", len(self.interfaces)) + b"".join(struct.pack(">H", i) for i in self.interfaces)]
        parts += [struct.pack(">H", len(x)) + b"".join(x) for x in (self.fields, self.methods, self.attributes)]
        return b"\xca\xfe\xba\xbe" + struct.pack(">HHH", self.version[1], self.version[0], len(self.constants) + 1) + pool + self.head + b"".join(parts)


def jar(entries: dict[str, bytes]) -> bytes:
    """A jar with some entries."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in sorted(entries.items()):
            z.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


def write_files(spark: SparkSession, directory: str, files: dict[str, bytes]) -> None:
    """Writes some small files into a directory of any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(directory).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, content in files.items():
        out = system.create(path(f"{directory}/{name}"), True)
        out.write(bytearray(content))
        out.close()
