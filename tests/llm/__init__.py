def thue_morse(n: int) -> list[str]:
    """Two texts of n letters that polynomials modulo a power of two can't tell apart."""
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return [text, text.translate(str.maketrans("ab", "ba"))]
