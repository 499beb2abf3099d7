DATA = "/root/testdata/sf0.001"
