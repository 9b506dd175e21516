"""Schemas of the tables. Times are nanoseconds since the snapshot's origin, addresses
longs; a column that a producer may leave out is nullable."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructType

_SEGMENT = StructType().add("start", LongType()).add("end", LongType())
_TYPES = {
    "long": LongType(),
    "int": IntegerType(),
    "string": StringType(),
    "boolean": BooleanType(),
    "binary": BinaryType(),
    "strings": ArrayType(StringType()),
    "segments": ArrayType(_SEGMENT),
}


def schema_of(text: str) -> StructType:
    """A name and a type in each line; needs no session, unlike Spark's own DDL."""
    out = StructType()
    for line in text.strip().splitlines():
        name, kind = line.split()
        out = out.add(name, _TYPES[kind])
    return out


RECORDS = schema_of("""
stream int
seq long
record_type string
pid int
tid int
cpu int
time_ns long
event string
ip long
addr long
flags string
insn_len int
insn string
start long
len long
pgoff long
prot string
path string
task_kind string
ppid int
ptid int
comm string
switch_out boolean
lost long
code int
message string
""")

EVENTS = schema_of("""
id long
thread string
sequence long
time_ns long
from_ip long
to_ip long
kind string
trace_begin boolean
trace_end boolean
async_event boolean
transaction boolean
interrupt boolean
syscall boolean
from_location long
to_location long
""")

SPANS = schema_of("""
id long
thread string
function long
parent long
start_ns long
end_ns long
completeness string
start_event long
end_event long
call_site long
""")

GAPS = schema_of("""
thread string
kind string
start_ns long
end_ns long
extent_known boolean
reason string
""")

THREADS = schema_of("""
id string
pid int
tid int
start_ns long
end_ns long
comm string
branch_count long
event_count long
span_count long
gap_count long
covered_ns long
segment_count long
segments segments
""")

FUNCTIONS = schema_of("""
id long
name string
demangled string
image_id string
start long
end long
""")

LOCATIONS = schema_of("""
id long
image_id string
image_offset long
virt_ip long
function long
file string
line long
inlined string
""")

MAPPINGS = schema_of("""
generation long
pid int
start long
end long
pgoff long
prot string
path string
build_id string
valid_from long
valid_to long
""")

INLINE_ROWS = schema_of("""
thread string
function long
chain strings
instructions long
blocks long
elapsed_ns long
""")

INSTRUCTIONS = schema_of("""
id long
thread string
sequence long
time_ns long
location long
virt_ip long
symbol string
inlined string
image_offset long
len int
kind string
branch_target long
fallthrough long
outcome string
bytes_hex string
""")

_FRAME = StructType().add("function", StringType()).add("file", StringType()).add("line", IntegerType())

IMAGES = schema_of("""
path string
image_id string
build_id string
""")

SEGMENTS = schema_of("""
image_id string
file_off long
file_size long
vaddr long
""")

CODE = schema_of("""
image_id string
page long
bytes binary
""")

INLINE_RANGES = StructType().add("image_id", StringType()).add("lo", LongType()).add("hi", LongType()).add("frames", ArrayType(_FRAME))

TABLES = {
    "events": EVENTS,
    "spans": SPANS,
    "gaps": GAPS,
    "threads": THREADS,
    "functions": FUNCTIONS,
    "locations": LOCATIONS,
    "mappings": MAPPINGS,
    "inline_rows": INLINE_ROWS,
    "instructions": INSTRUCTIONS,
    "images": IMAGES,
    "segments": SEGMENTS,
    "inline_ranges": INLINE_RANGES,
    "code": CODE,
}
