"""Where the test tables lie."""

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
