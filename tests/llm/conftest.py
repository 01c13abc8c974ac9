"""Lets tests of this folder use each other's plain versions."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
