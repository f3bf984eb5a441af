import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from trialframe.session import local_session
    s = local_session(cores=4, shuffle_partitions=4, app="trialframe-tests")
    from trialframe.session import checkpoint_dir
    checkpoint_dir(s)          # the session's shared folder, or a scratch one when unset
    yield s
