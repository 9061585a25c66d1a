"""Write demandspark.zip for ``spark-submit --py-files``: workers import the kernels from it.

Usage: python scripts/package.py [target.zip]
"""

from __future__ import annotations

import os
import sys
import zipfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    target = sys.argv[1] if len(sys.argv) > 1 else "demandspark.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "demandspark")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, ROOT))
        for name in ("__spark_entry__.py", "corpus_pipeline.py"):
            if os.path.exists(os.path.join(ROOT, name)):
                z.write(os.path.join(ROOT, name), name)
    print(target)


if __name__ == "__main__":
    main()
