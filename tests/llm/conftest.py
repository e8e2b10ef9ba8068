import sys
from pathlib import Path

from hypothesis import settings

sys.path.insert(0, str(Path(__file__).parent))
settings.register_profile("own", deadline=None, max_examples=60)
settings.load_profile("own")
