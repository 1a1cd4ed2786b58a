"""Comparison of a query's rows with those of its SQL."""


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows(frame):
    """Rows of a pandas frame as sorted text, columns by name."""
    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(plain(v) for v in r)) for r in frame[columns].astype(object).itertuples(index=False))


#: Small sources in three languages.
SAMPLES = (
    (1, "python", "import os\n\n@wrap\ndef one(a):\n    # note\n    return 'x'\n\n\nclass Two:\n    def three(self):\n        pass\n\nlast = 1\n"),
    (2, "rust", "pub fn area(r: f64) -> f64 {\n    r * r // }\n}\n\nstruct P;\n\nimpl<T> Shape for P where T: X {\n    fn side(&self) {}\n}\nmacro_rules! twice { () => {}; }\n"),
    (3, "clike", "#include <x.h>\n\nstruct S {\n  int a;\n};\n\nstatic int sum(int a,\n  int b)\n{\n  return a + b; /* } */\n}\n\nint main(void) {\n  if (sum(1, 2)) { return \"}\"[0]; }\n}\nint other(int);\n"),
)
