"""The 53-point series of the fixtures: a 32-bit multiplicative generator, six draws a point."""

import struct

R = 2147483646


def points(n=53, t0=100, dt=10):
    x = 1

    def draw():
        nonlocal x
        x = ((48271 * x) & 0xFFFFFFFF) % 0x7FFFFFFF
        return x

    f32 = lambda v: struct.unpack("f", struct.pack("f", v))[0]
    out = []
    for i in range(n):
        a, b, c = draw(), draw(), draw()
        values = (a, b / R, f32(f32(c) / f32(R)))
        known = [draw() > R // 4 for _ in range(3)]
        out.append((t0 + dt * i, *[v if k else None for v, k in zip(values, known)]))
    return out


SCHEMA = "field1/u32,field2/f64,field3/f32"
