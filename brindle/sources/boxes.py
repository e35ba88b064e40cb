"""The catalogue of named frames (boxes) that a question is asked over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Boxes:
    def __init__(self, spark: SparkSession):
        self.spark, self.frames = spark, {}

    def add(self, name: str, df: DataFrame, prefix: str = "") -> None:
        """Registers df under prefix + name, dots as underscores; a second box of one name is an error."""
        name = f"{prefix}{name}".replace(".", "_")
        if name in self.frames:
            raise ValueError(f"there is a box {name} already")
        self.frames[name] = df
        df.createOrReplaceTempView(f"`{name}`")

    def add_all(self, frames: dict[str, DataFrame], prefix: str = "") -> None:
        for name, df in frames.items():
            self.add(name, df, prefix)

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]

    def schema_text(self) -> str:
        """The boxes as the text that planners read."""
        blocks = []
        for name, df in self.frames.items():
            lines = [f'    "{f.name}": [],  # ({f.dataType.simpleString()}){", " + f.metadata["meaning"] if "meaning" in f.metadata else ""}' for f in df.schema]
            blocks.append("\n".join([f"{name} = pd.DataFrame({{", *lines, "})"]))
        return "\n\n".join(blocks)

    def preview(self, name: str, n: int = 3) -> list:
        return self.frames[name].limit(n).collect()


def parse_schema(text: str) -> dict[str, dict[str, tuple[str, str]]]:
    """table -> column -> (type, meaning) from schema_text()."""
    import re

    out: dict[str, dict[str, tuple[str, str]]] = {}
    for block in re.finditer(r"(\w+) = pd\.DataFrame\(\{\n(.*?)\n\}\)", text, re.S):
        out[block[1]] = {m[1]: (m[2], m[3] or "") for m in re.finditer(r'"([^"]+)": \[\],  # \(([^)]*)\)(?:, (.*))?', block[2])}
    return out
