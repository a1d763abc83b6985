"""A small byte-code machine for programs that blocks carry.

Registers a, b, c, d (32 bits), a flag f, 256 registers r, a byte array m and a
word array h whose sizes are powers of two. A program runs once for each input
byte, which a holds when it starts, and once more at the end with a = 2^32 - 1.
``out`` emits the low byte of a. Division by zero and its remainder give zero.

Programs are lists of (operation, operand) pairs made by ``assemble`` from text,
one operation a line: ``a=b``, ``*c=a``, ``a+=12``, ``d<>a``, ``b++``, ``a==0``,
``jt 3``, ``jf -2``, ``jmp 4`` (relative to the next operation), ``lj 7``
(absolute), ``out``, ``hash``, ``hashd``, ``a=r 5``, ``r=a 5``, ``halt``.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
PLACES = ("a", "b", "c", "d", "*b", "*c", "*d")
BINARY = ("+=", "-=", "*=", "/=", "%=", "&=", "&~", "|=", "^=", "<<=", ">>=", "==", "<", ">", "=")


class BadProgram(ValueError):
    """A program with an unknown operation or a jump out of its bounds."""


def assemble(text: str) -> list[tuple]:
    out: list[tuple] = []
    for raw in text.splitlines():
        line = raw.split(";")[0].strip()
        if not line:
            continue
        if line in ("halt", "out", "hash", "hashd"):
            out.append((line,))
        elif m := re.fullmatch(r"(jt|jf|jmp|lj)\s+(-?\d+)", line):
            out.append((m[1], int(m[2])))
        elif m := re.fullmatch(r"([abcd])=r\s+(\d+)", line):
            out.append(("load", m[1], int(m[2]) & 255))
        elif m := re.fullmatch(r"r=a\s+(\d+)", line):
            out.append(("keep", int(m[1]) & 255))
        elif m := re.fullmatch(r"(\*?[abcd])(\+\+|--|!|=0)", line):
            out.append((m[2], m[1]))
        elif m := re.fullmatch(r"(\*?[bcd])<>a", line):
            out.append(("<>", m[1]))
        elif m := re.fullmatch(r"(\*?[abcd])(\+=|-=|\*=|/=|%=|&=|&~|\|=|\^=|<<=|>>=|==|<|>|=)(\*?[abcd]|\d+)", line):
            if m[2] != "=" and m[1] != "a":
                raise BadProgram(line)
            out.append((m[2], m[1], int(m[3]) & MASK if m[3].isdigit() else m[3]))
        else:
            raise BadProgram(line)
        for place in out[-1][1:]:
            if isinstance(place, str) and place not in PLACES:
                raise BadProgram(line)
    for at, op in enumerate(out):
        target = op[1] if op[0] == "lj" else at + 1 + op[1] if op[0] in ("jt", "jf", "jmp") else 0
        if not 0 <= target <= len(out):
            raise BadProgram(f"jump to {target}")
    return out


class Machine:
    def __init__(self, program: list[tuple], h_bits: int = 4, m_bits: int = 8, steps: int = 10_000_000):
        self.program, self.left = program, steps
        self.reg = dict.fromkeys("abcd", 0)
        self.f, self.r = False, [0] * 256
        self.m, self.h = bytearray(1 << m_bits), [0] * (1 << h_bits)
        self.emitted = bytearray()

    def get(self, place: str | int) -> int:
        if isinstance(place, int):
            return place
        if place[0] != "*":
            return self.reg[place]
        i = self.reg[place[1]]
        return self.h[i % len(self.h)] if place[1] == "d" else self.m[i % len(self.m)]

    def put(self, place: str, value: int) -> None:
        value &= MASK
        if place[0] != "*":
            self.reg[place] = value
            return
        i = self.reg[place[1]]
        if place[1] == "d":
            self.h[i % len(self.h)] = value
        else:
            self.m[i % len(self.m)] = value & 255

    def run(self, a: int) -> None:
        reg, at = self.reg, 0
        reg["a"] = a
        while at < len(self.program):
            self.left -= 1
            if self.left < 0:
                raise BadProgram("too many steps")
            op, *args = self.program[at]
            at += 1
            if op == "halt":
                return
            if op == "out":
                self.emitted.append(reg["a"] & 255)
            elif op == "hash":
                reg["a"] = (reg["a"] + self.get("*b") + 512) * 773 & MASK
            elif op == "hashd":
                self.put("*d", (self.get("*d") + reg["a"] + 512) * 773)
            elif op in ("jt", "jf", "jmp"):
                if op == "jmp" or self.f == (op == "jt"):
                    at += args[0]
            elif op == "lj":
                at = args[0]
            elif op == "load":
                reg[args[0]] = self.r[args[1]]
            elif op == "keep":
                self.r[args[0]] = reg["a"]
            elif op == "++":
                self.put(args[0], self.get(args[0]) + 1)
            elif op == "--":
                self.put(args[0], self.get(args[0]) - 1)
            elif op == "!":
                self.put(args[0], ~self.get(args[0]))
            elif op == "=0":
                self.put(args[0], 0)
            elif op == "<>":
                if args[0] in ("*b", "*c"):  # a byte changes places with the low byte of a
                    low, byte = reg["a"] & 255, self.get(args[0])
                    self.put(args[0], low)
                    reg["a"] = reg["a"] & ~255 | byte
                else:
                    old = self.get(args[0])
                    self.put(args[0], reg["a"])
                    reg["a"] = old
            else:
                x, y = self.get(args[0]), self.get(args[1])
                if op in ("==", "<", ">"):
                    self.f = x == y if op == "==" else x < y if op == "<" else x > y
                else:
                    self.put(args[0], combine(op, x, y))


def combine(op: str, x: int, y: int) -> int:
    if op == "=":
        return y
    if op in ("/=", "%="):
        return (x // y if op == "/=" else x % y) if y else 0
    if op == "<<=":
        return x << (y & 31)
    if op == ">>=":
        return x >> (y & 31)
    return {"+=": x + y, "-=": x - y, "*=": x * y, "&=": x & y, "&~": x & ~y, "|=": x | y, "^=": x ^ y}[op]


def execute(program: list[tuple], data: bytes, h_bits: int = 4, m_bits: int = 8) -> bytes:
    machine = Machine(program, h_bits, m_bits)
    for byte in data:
        machine.run(byte)
    machine.run(MASK)
    return bytes(machine.emitted)


#: Undoes differences of neighbouring bytes: each byte is added to the one before it.
UNDELTA = "a>255\njt 4\na+=*b\n*b=a\nout\nhalt\n"


def run_program(text: str, data: Column, h_bits: int = 4, m_bits: int = 8) -> Column:
    """The output of one program over each binary value."""
    program = assemble(text)

    @F.pandas_udf("binary")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else execute(program, bytes(b), h_bits, m_bits))

    return of(data.cast("binary"))
