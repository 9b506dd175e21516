"""Lengths and control flow of 64-bit x86 instructions, for whole arrays of them at once.

Only what a trace needs is decoded: how long an instruction is, whether it branches, and
where to. Operands are skipped by their sizes, which opcode, prefixes and ModRM give.
"""

from __future__ import annotations

import numpy as np

#: Bytes of the longest instruction.
LONGEST = 15

# The kinds of instructions.
KINDS = ("other", "sequential", "conditional", "jump", "indirect_jump", "call", "indirect_call", "return")
_KIND = {name: k for k, name in enumerate(KINDS)}


def _set(*parts) -> np.ndarray:
    """A table over opcodes: true for the numbers and (first, last) ranges given."""
    out = np.zeros(256, bool)
    for p in parts:
        a, b = p if isinstance(p, tuple) else (p, p)
        out[a : b + 1] = True
    return out


_ARITHMETIC = np.arange(256) < 0x40  # eight operations of eight opcodes each
_LOW = np.arange(256) & 7

# The opcode maps of 64-bit mode. 0 is the one-byte map, 1 to 3 are 0f, 0f38 and 0f3a.
LEGACY = _set(0x26, 0x2E, 0x36, 0x3E, (0x64, 0x67), 0xF0, 0xF2, 0xF3)
BAD = (
    _set(0x06, 0x07, 0x0E, 0x16, 0x17, 0x1E, 0x1F, 0x27, 0x2F, 0x37, 0x3F, 0x60, 0x61, 0x82, 0x9A, 0xCE, (0xD4, 0xD6), 0xEA),
    _set(0x04, 0x0A, 0x0C, (0x24, 0x27), 0x36, 0x39, (0x3B, 0x3F), 0x7A, 0x7B),
)
MODRM = (
    (_ARITHMETIC & (_LOW < 4)) | _set(0x63, 0x69, 0x6B, 0x80, 0x81, 0x83, (0x84, 0x8F), 0xC0, 0xC1, 0xC6, 0xC7, (0xD0, 0xD3), (0xD8, 0xDF), 0xF6, 0xF7, 0xFE, 0xFF),
    ~_set((0x05, 0x09), 0x0B, 0x0E, (0x30, 0x37), 0x77, (0x80, 0x8F), (0xA0, 0xA2), (0xA8, 0xAA), (0xC8, 0xCF)),
)
BYTE = (
    (_ARITHMETIC & (_LOW == 4)) | _set(0x6A, 0x6B, (0x70, 0x7F), 0x80, 0x83, 0xA8, (0xB0, 0xB7), 0xC0, 0xC1, 0xC6, 0xC8, 0xCD, (0xE0, 0xE7), 0xEB),
    _set(0x0F, (0x70, 0x73), 0xA4, 0xAC, 0xBA, 0xC2, (0xC4, 0xC6)),
)
#: Four bytes, or two with an operand-size prefix; near branches always have four.
WORD = (_ARITHMETIC & (_LOW == 5)) | _set(0x68, 0x69, 0x81, 0xA9, 0xC7)
NEAR = (_set(0xE8, 0xE9), _set((0x80, 0x8F)))
SHORT = _set((0x70, 0x7F), (0xE0, 0xE3), 0xEB)

_FLOW = (
    (("conditional", _set((0x70, 0x7F), (0xE0, 0xE3))), ("jump", _set(0xE9, 0xEB)), ("call", _set(0xE8)), ("return", _set(0xC2, 0xC3, 0xCA, 0xCB, 0xCF)), ("other", _set(0xCC, 0xCD, 0xF1))),
    (("conditional", _set((0x80, 0x8F))), ("call", _set(0x05, 0x34)), ("return", _set(0x07, 0x35, 0xAA)), ("other", _set(0x0B, 0xB9, 0xFF))),
)
#: 0f 01 with these ModRM bytes enters or leaves a virtual machine.
MACHINE = _set((0xC1, 0xC3), 0xD8, 0xD9)


def decode(code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length, kind, targeted, displacement) of the instruction that begins each row of ``code``.

    ``code`` is (n, at least LONGEST) bytes, of which ``size`` are known in each row.
    Length 0 marks what is no whole valid instruction; its kind is ``other``. ``kind`` indexes KINDS. Where
    ``targeted`` the branch goes to the instruction's end plus ``displacement``.
    """
    n = len(code)
    rows, last = np.arange(n), code.shape[1] - 1
    byte = lambda at: code[rows, np.minimum(at, last)].astype(np.int64)
    at, rex = np.zeros(n, np.int64), np.zeros(n, np.int64)
    short_operand, short_address, repeat = (np.zeros(n, bool) for _ in range(3))
    going = np.ones(n, bool)
    for _ in range(LONGEST):
        b = byte(at)
        legacy, is_rex = going & LEGACY[b], going & (b >> 4 == 4)
        going = legacy | is_rex
        if not going.any():
            break
        short_operand |= legacy & (b == 0x66)
        short_address |= legacy & (b == 0x67)
        repeat |= legacy & (b == 0xF2)
        rex = np.where(is_rex, b, np.where(legacy, 0, rex))  # only one right before the opcode counts
        at += going
    wide = rex & 8 != 0

    first = byte(at)
    second, third = byte(at + 1), byte(at + 2)
    table = np.zeros(n, np.int64)
    vex2, vex3, evex = first == 0xC5, first == 0xC4, first == 0x62
    xop = (first == 0x8F) & (second & 0x1F >= 8)
    two = first == 0x0F
    table = np.where(two, np.where(second == 0x38, 2, np.where(second == 0x3A, 3, 1)), table)
    table = np.where(vex2, 1, np.where(vex3, second & 0x1F, np.where(evex, second & 7, np.where(xop, second & 0x1F, table))))
    at = at + np.select([vex2, vex3 | xop, evex, two & (table > 1), two], [2, 3, 4, 2, 1], 0)
    vector = vex2 | vex3 | evex | xop
    op = byte(at)
    at = at + 1
    plain, second_map = table == 0, table == 1

    bad = (plain & BAD[0][op]) | (second_map & ~vector & BAD[1][op])
    bad |= (vex3 & ((table < 1) | (table > 3))) | (evex & ~np.isin(table, (1, 2, 3, 5, 6))) | (xop & (table > 10))
    has = np.where(plain, MODRM[0][op], np.where(second_map & ~vector, MODRM[1][op], ~((vex2 | vex3) & second_map & (op == 0x77))))
    modrm = np.where(has, byte(at), 0)
    mode, reg, rm = modrm >> 6, modrm >> 3 & 7, modrm & 7
    mode = np.where(second_map & ~vector & (op >= 0x20) & (op <= 0x23), 3, mode)  # control registers
    at = at + has
    scaled = has & (mode != 3) & (rm == 4)
    base = np.where(scaled, byte(at) & 7, 0)
    at = at + scaled
    at = at + np.select([has & (mode == 1), has & (mode == 2), has & (mode == 0) & ((rm == 5) | (scaled & (base == 5)))], [1, 4, 4], 0)

    # Immediate operands.
    group3 = plain & ((op == 0xF6) | (op == 0xF7)) & (reg < 2)
    word = np.where(short_operand & ~wide, 2, 4)
    imm = np.where(plain, BYTE[0][op] * 1 + WORD[op] * word + NEAR[0][op] * 4, 0)
    imm = imm + np.where(plain & _set(0xC2, 0xC8, 0xCA)[op], 2, 0)
    imm = imm + np.where(plain & (op >= 0xA0) & (op <= 0xA3), np.where(short_address, 4, 8), 0)
    imm = imm + np.where(plain & (op >= 0xB8) & (op <= 0xBF), np.where(wide, 8, word), 0)
    imm = imm + np.where(group3, np.where(op == 0xF6, 1, word), 0)
    imm = imm + np.where(second_map, BYTE[1][op] * 1, 0) * ~(vector & (op == 0x0F))
    imm = imm + np.where(second_map & ~vector, NEAR[1][op] * 4, 0)
    imm = imm + np.where(second_map & ~vector & (op == 0x78) & (short_operand | repeat), 2, 0)
    imm = imm + np.where((table == 3) | (xop & (table == 8)), 1, np.where(xop & (table == 10), 4, 0))
    length = at + imm
    bad |= (plain & (op == 0xFF) & (reg == 7)) | (plain & (op == 0xFE) & (reg > 1)) | (length > LONGEST) | (length > size)

    kind = np.full(n, _KIND["sequential"])
    for number, flows in enumerate(_FLOW):
        own = plain if number == 0 else second_map & ~vector
        for name, ops in flows:
            kind[own & ops[op]] = _KIND[name]
    far = plain & (op == 0xFF)
    kind[far & ((reg == 2) | (reg == 3))] = _KIND["indirect_call"]
    kind[far & ((reg == 4) | (reg == 5))] = _KIND["indirect_jump"]
    kind[plain & ((op == 0xC6) | (op == 0xC7)) & (modrm == 0xF8)] = _KIND["other"]  # transactions
    kind[second_map & ~vector & (op == 0x01) & MACHINE[modrm]] = _KIND["call"]

    near = (plain & NEAR[0][op]) | (second_map & ~vector & NEAR[1][op])
    one = plain & SHORT[op]
    far_by = sum(byte(at + k) << 8 * k for k in range(4))
    displacement = np.where(near, (far_by ^ 1 << 31) - (1 << 31), np.where(one, (byte(at) ^ 0x80) - 0x80, 0))
    length = np.where(bad, 0, length)
    return length, np.where(bad, _KIND["other"], kind), (near | one) & ~bad, displacement


def windows(code: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of LONGEST bytes, padded with zeros, and how many are known."""
    size = np.fromiter((min(len(x), LONGEST) for x in code), np.int64, len(code))
    return np.frombuffer(b"".join(x[:LONGEST].ljust(LONGEST, b"\0") for x in code), np.uint8).reshape(-1, LONGEST), size


def count_instructions(blocks: list[bytes], reach: np.ndarray) -> np.ndarray:
    """How many instructions of each block begin at ``reach`` or before, read one after the other from its first byte.

    What is no whole valid instruction ends the count.
    """
    size = np.fromiter(map(len, blocks), np.int64, len(blocks))
    data = np.frombuffer(b"".join(blocks) + bytes(LONGEST), np.uint8)
    start = np.cumsum(size) - size
    at, n = np.zeros(len(blocks), np.int64), np.zeros(len(blocks), np.int64)
    left = np.flatnonzero(size > 0)
    while len(left):
        code = data[(start[left] + at[left])[:, None] + np.arange(LONGEST)]
        length = decode(code, size[left] - at[left])[0]
        left, length = left[length > 0], length[length > 0]
        n[left] += 1
        at[left] += length
        left = left[(at[left] <= reach[left]) & (at[left] < size[left])]
    return n
