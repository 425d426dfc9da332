from __future__ import annotations

import os
import sys
from pathlib import Path

# workers import the package by name
root = str(Path(__file__).resolve().parents[2])
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (root, os.environ.get("PYTHONPATH"))))
sys.path.insert(0, str(Path(__file__).resolve().parent))
