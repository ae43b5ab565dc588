def mulberry(seed, n):
    out, state = [], seed & 0xFFFFFFFF
    for _ in range(n):
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ state >> 15) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        out.append((t ^ t >> 14) / 4294967296)
    return out
