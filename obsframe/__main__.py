from .shell import main

main()
