"""Event schemas: which event types and fields exist, and where a field is in an event DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from emberline.plans.errors import UnknownEventType, UnknownField

#: field types by name
SPARK_TYPES: dict[str, T.DataType] = {
    "i64": T.LongType(),
    "u64": T.DecimalType(20, 0),
    "string": T.StringType(),
    "bool": T.BooleanType(),
    "f64": T.DoubleType(),
    "bytes": T.BinaryType(),
}
SEVERITIES = ("informational", "low", "medium", "high", "critical")
SEVERITY_RANK = {s: i for i, s in enumerate(SEVERITIES)}


@dataclass(frozen=True)
class FieldDef:
    """A field; ``array`` of ``kind`` if ``is_array``. ``column`` is its place in the DataFrame, its path unless given."""

    path: str
    kind: str
    description: str = ""
    is_array: bool = False
    column: str | None = None

    @property
    def spark(self) -> T.DataType:
        one = SPARK_TYPES[self.kind]
        return T.ArrayType(one) if self.is_array else one


@dataclass(frozen=True)
class EventTypeDef:
    name: str
    description: str = ""
    parent: str | None = None


@dataclass
class Schema:
    """Registered event types and fields. ``open_fields`` lets rules name others, which are null everywhere."""

    types: dict[str, EventTypeDef] = field(default_factory=dict)
    fields: dict[str, FieldDef] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    type_aliases: dict[str, str] = field(default_factory=dict)
    open_fields: bool = False

    def add_type(self, name: str, description: str = "", parent: str | None = None, aliases: Iterable[str] = ()) -> Schema:
        if name in self.types:
            raise ValueError(f"event type {name} is registered already")
        self.types[name] = EventTypeDef(name, description, parent)
        for a in aliases:
            self.type_aliases[a] = name
        return self

    def add_field(self, path: str, kind: str, description: str = "", is_array: bool = False, column: str | None = None, aliases: Iterable[str] = ()) -> Schema:
        if path in self.fields:
            raise ValueError(f"field {path} is registered already")
        if kind not in SPARK_TYPES:
            raise ValueError(f"no field type {kind}")
        self.fields[path] = FieldDef(path, kind, description, is_array, column)
        for a in aliases:
            self.aliases[a] = path
        return self

    def event_type(self, name: str) -> str:
        name = self.type_aliases.get(name, name)
        if name not in self.types:
            raise UnknownEventType(f"no event type {name}")
        return name

    def lookup(self, path: str) -> FieldDef | None:
        path = self.aliases.get(path, path)
        if path in self.fields:
            return self.fields[path]
        if self.open_fields:
            return None
        raise UnknownField(f"no field {path}")

    def struct(self) -> T.StructType:
        """The DataFrame schema: one nested column per first part of the paths, beside the event's own columns."""
        tree: dict = {}
        for f in self.fields.values():
            at = tree
            *front, last = f.path.split(".")
            for part in front:
                at = at.setdefault(part, {})
            at[last] = f.spark

        def build(node: Mapping) -> T.StructType:
            return T.StructType([T.StructField(k, build(v) if isinstance(v, dict) else v) for k, v in node.items()])

        return T.StructType([*EVENT_COLUMNS, *build(tree).fields])


EVENT_COLUMNS = [
    T.StructField("event_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("ts_mono_ns", T.LongType()),
    T.StructField("ts_wall_ns", T.LongType()),
    T.StructField("entity_key", T.StringType()),
    T.StructField("source_id", T.StringType()),
]


def host_schema() -> Schema:
    """Event types and fields of endpoint telemetry, under all the names and numbers that rules use for them."""
    s = Schema()
    for name, about, numbers in (
        ("process_exec", "a process starts a program", ("1", "1001", "process", "exec")),
        ("process_exit", "a process ends", ("2", "1002", "exit")),
        ("file_create", "a file is opened or made", ("3", "3001", "file", "open", "file_open")),
        ("file_rename", "a file gets another name", ("4", "3002", "rename")),
        ("file_unlink", "a file is removed", ("5", "unlink")),
        ("file_write", "a file is written", ("3003",)),
        ("file_read", "a file is read", ("3004",)),
        ("network_connect", "a connection is opened", ("6", "4001", "network", "connect")),
        ("network_send", "data are sent", ("7", "4002", "send")),
        ("service_start", "a service starts", ("5001",)),
        ("authentication", "somebody logs in, or fails to", ("6001",)),
    ):
        s.add_type(name, about, aliases=numbers)
    for path, kind, aliases in (
        ("process.pid", "i64", ("2",)),
        ("process.ppid", "i64", ("6",)),
        ("process.uid", "i64", ("10",)),
        ("process.euid", "i64", ("11",)),
        ("process.gid", "i64", ()),
        ("process.name", "string", ("3",)),
        ("process.executable", "string", ("4",)),
        ("process.command_line", "string", ("5",)),
        ("process.exit_code", "i64", ()),
        ("process.entity_id", "string", ()),
        ("file.path", "string", ("20",)),
        ("file.new_path", "string", ("21",)),
        ("file.name", "string", ()),
        ("file.size", "i64", ("22",)),
        ("network.direction", "string", ()),
        ("network.dest_ip", "string", ("50",)),
        ("network.dest_port", "i64", ("51",)),
        ("network.src_port", "i64", ("53",)),
        ("network.dest_host", "string", ("54",)),
        ("service.name", "string", ("60",)),
        ("auth.kind", "string", ("70",)),
        ("auth.result", "string", ("71",)),
        ("auth.src_ip", "string", ("72",)),
    ):
        s.add_field(path, kind, aliases=aliases)
    s.add_field("process.args", "string", is_array=True)
    s.add_field("file.permissions", "i64", is_array=True)
    return s


def schema_of(df: DataFrame, types: Iterable[str], open_fields: bool = False) -> Schema:
    """A schema with all columns of ``df``, nested ones too, as fields."""
    s = Schema(open_fields=open_fields)
    for t in types:
        s.add_type(t)

    def kind(t: T.DataType) -> str | None:
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return "i64"
        if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            return "f64"
        return {T.StringType: "string", T.BooleanType: "bool", T.BinaryType: "bytes"}.get(type(t))

    def walk(prefix: str, fields: Iterable[T.StructField]) -> None:
        for f in fields:
            path = f"{prefix}{f.name}"
            if isinstance(f.dataType, T.StructType):
                walk(f"{path}.", f.dataType.fields)
            elif isinstance(f.dataType, T.ArrayType):
                if k := kind(f.dataType.elementType):
                    s.add_field(path, k, is_array=True)
            elif k := kind(f.dataType):
                s.add_field(path, k)

    walk("", df.schema.fields)
    return s
