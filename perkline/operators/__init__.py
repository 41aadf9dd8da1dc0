"""Parameterised DataFrame operators. Each is a pure function of frames; none reads, writes, caches or collects."""
