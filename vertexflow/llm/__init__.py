"""Operations for large training corpora; nothing outside this package imports it."""
